"""The languages of ISO 639 that have a code of two letters: alpha-2, alpha-3, bibliographic alpha-3 where it differs, English name."""

from __future__ import annotations

_TABLE = """
aa aar Afar|ab abk Abkhazian|ae ave Avestan|af afr Afrikaans|ak aka Akan|am amh Amharic|an arg Aragonese|ar ara Arabic|as asm Assamese|av ava Avaric|ay aym Aymara|az aze Azerbaijani
ba bak Bashkir|be bel Belarusian|bg bul Bulgarian|bi bis Bislama|bm bam Bambara|bn ben Bengali|bo bod/tib Tibetan|br bre Breton|bs bos Bosnian|ca cat Catalan|ce che Chechen|ch cha Chamorro|co cos Corsican
cr cre Cree|cs ces/cze Czech|cu chu Church Slavic|cv chv Chuvash|cy cym/wel Welsh|da dan Danish|de deu/ger German|dv div Dhivehi|dz dzo Dzongkha|ee ewe Ewe|el ell/gre Modern Greek (1453-)|en eng English
eo epo Esperanto|es spa Spanish|et est Estonian|eu eus/baq Basque|fa fas/per Persian|ff ful Fulah|fi fin Finnish|fj fij Fijian|fo fao Faroese|fr fra/fre French|fy fry Western Frisian|ga gle Irish
gd gla Scottish Gaelic|gl glg Galician|gn grn Guarani|gu guj Gujarati|gv glv Manx|ha hau Hausa|he heb Hebrew|hi hin Hindi|ho hmo Hiri Motu|hr hrv Croatian|ht hat Haitian|hu hun Hungarian|hy hye/arm Armenian
hz her Herero|ia ina Interlingua|id ind Indonesian|ie ile Interlingue|ig ibo Igbo|ii iii Sichuan Yi|ik ipk Inupiaq|io ido Ido|is isl/ice Icelandic|it ita Italian|iu iku Inuktitut|ja jpn Japanese
jv jav Javanese|ka kat/geo Georgian|kg kon Kongo|ki kik Kikuyu|kj kua Kuanyama|kk kaz Kazakh|kl kal Kalaallisut|km khm Khmer|kn kan Kannada|ko kor Korean|kr kau Kanuri|ks kas Kashmiri|ku kur Kurdish
kv kom Komi|kw cor Cornish|ky kir Kirghiz|la lat Latin|lb ltz Luxembourgish|lg lug Ganda|li lim Limburgan|ln lin Lingala|lo lao Lao|lt lit Lithuanian|lu lub Luba-Katanga|lv lav Latvian|mg mlg Malagasy
mh mah Marshallese|mi mri/mao Maori|mk mkd/mac Macedonian|ml mal Malayalam|mn mon Mongolian|mr mar Marathi|ms msa/may Malay|mt mlt Maltese|my mya/bur Burmese|na nau Nauru|nb nob Norwegian Bokmål
nd nde North Ndebele|ne nep Nepali|ng ndo Ndonga|nl nld/dut Dutch|nn nno Norwegian Nynorsk|no nor Norwegian|nr nbl South Ndebele|nv nav Navajo|ny nya Nyanja|oc oci Occitan|oj oji Ojibwa|om orm Oromo
or ori Oriya|os oss Ossetian|pa pan Panjabi|pi pli Pali|pl pol Polish|ps pus Pushto|pt por Portuguese|qu que Quechua|rm roh Romansh|rn run Rundi|ro ron/rum Romanian|ru rus Russian|rw kin Kinyarwanda
sa san Sanskrit|sc srd Sardinian|sd snd Sindhi|se sme Northern Sami|sg sag Sango|sh hbs Serbo-Croatian|si sin Sinhala|sk slk/slo Slovak|sl slv Slovenian|sm smo Samoan|sn sna Shona|so som Somali|sq sqi/alb Albanian
sr srp Serbian|ss ssw Swati|st sot Southern Sotho|su sun Sundanese|sv swe Swedish|sw swa Swahili|ta tam Tamil|te tel Telugu|tg tgk Tajik|th tha Thai|ti tir Tigrinya|tk tuk Turkmen|tl tgl Tagalog|tn tsn Tswana
to ton Tonga|tr tur Turkish|ts tso Tsonga|tt tat Tatar|tw twi Twi|ty tah Tahitian|ug uig Uighur|uk ukr Ukrainian|ur urd Urdu|uz uzb Uzbek|ve ven Venda|vi vie Vietnamese|vo vol Volapük|wa wln Walloon
wo wol Wolof|xh xho Xhosa|yi yid Yiddish|yo yor Yoruba|za zha Zhuang|zh zho/chi Chinese|zu zul Zulu
"""


def _row(entry: str) -> tuple[str, str, str | None, str]:
    a2, codes, name = entry.split(" ", 2)
    a3, _, bib = codes.partition("/")
    return a2, a3, bib or None, name


#: alpha-2, alpha-3, bibliographic alpha-3 or None, English name.
LANGUAGES = tuple(_row(e) for line in _TABLE.split("\n") if line for e in line.split("|"))
