"""Scalar rules as column expressions: times, rates, paths, languages, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgrid.functions.languages import LANGUAGES

VIDEO = ("mkv", "mp4", "avi", "mpg", "mpeg", "mov", "rmvb")
TEXT_SUBTITLES = ("srt", "ass", "ssa", "sub", "vtt", "txt", "smi", "ttml", "mpl")
FORMATS = {"srt": "srt", "ass": "ass", "ssa": "ssa", "sub": "microdvd", "vtt": "vtt", "txt": "tmp", "ttml": "ttml", "mpl": "mpl2"}



def language_map() -> Column:
    """Any known code or name, in small letters, to its alpha-3 code."""
    pairs = {k.lower(): a3 for a2, a3, bib, name in LANGUAGES for k in (a2, a3, bib, name) if k}
    return F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv])


def unify_language(code: Column, strict: bool = False) -> Column:
    """Two-letter, three-letter or bibliographic code to alpha-3; NULL for 'und'; an unknown code is NULL, or an error if ``strict``."""
    low = F.lower(F.trim(code))
    found = F.when(F.length(low).between(2, 3), F.try_element_at(language_map(), low))
    if not strict:
        return found
    return F.when(found.isNull() & (low != "und"), F.raise_error(F.concat(F.lit("unknown language code "), code))).otherwise(found)


def language_name(code: Column) -> Column:
    """English name of a code, 'Unknown' without one."""
    names = F.create_map(*[F.lit(x) for _, a3, _, name in LANGUAGES for x in (a3, name)])
    return F.coalesce(F.try_element_at(names, unify_language(code)), F.lit("Unknown"))


def time_to_ms(text: Column) -> Column:
    """HH:MM:SS and a fraction cut to three digits (not padded) to milliseconds; NULL for anything else."""
    p = F.split(text, "[:.,]")
    n = lambda i: F.get(p, F.lit(i)).try_cast("bigint")
    ms = F.substring(F.get(p, F.lit(3)), 1, 3).try_cast("bigint")
    return F.when(F.size(p) == 4, ((n(0) * 60 + n(1)) * 60 + n(2)) * 1000 + ms)


def ms_to_time(ms: Column) -> Column:
    """Milliseconds to HH:MM:SS,mmm."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000)


def rate(text: Column) -> Column:
    """'30000/1001' or '25' to frames a second; NULL when it isn't a positive number."""
    num = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double")
    den = F.coalesce(F.nullif(F.split_part(text, F.lit("/"), F.lit(2)), F.lit("")), F.lit("1")).try_cast("double")
    return F.when((num > 0) & (den > 0), num / den)


def seconds_to_ms(x: Column) -> Column:
    """Seconds, as number or text, to whole milliseconds, half to even; NULL when unreadable."""
    return F.bround(x.try_cast("double") * 1000).cast("bigint")


def path_dir(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def path_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def path_stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(path_name(path), "(?<=.)\\.[^.]*$", "")


def path_ext(path: Column) -> Column:
    """Last suffix without the dot, in small letters."""
    return F.lower(F.regexp_extract(path_name(path), "^.+\\.([^.]*)$", 1))


def is_video(path: Column) -> Column:
    return path_ext(path).isin(*VIDEO)


def split_part(path: Column) -> Column:
    """(name, part) of a path that names a part 'cdN'; NULL for other paths.

    The name is the path without the part: ``/dir/film cd1.avi`` and
    ``/dir/film/cd1.avi`` belong to ``/dir/film.avi`` and
    ``/dir/film/film.avi``.  Names ending in rmvb end in mkv.
    """
    rule = "(?i)^(.*[^0-9a-z]+)(cd[0-9]+)([^0-9a-z]+.*)"
    head, part, tail = (F.regexp_extract(path, rule, i) for i in (1, 2, 3))
    base = F.when(head.endswith("/"), F.concat(head, F.regexp_extract(head, "([^/]*)/+$", 1))).otherwise(F.substr(head, F.lit(1), F.length(head) - 1))
    name = F.regexp_replace(F.concat(base, tail), "(?i)(?<=[^/])\\.rmvb$", ".mkv")
    return F.when(part != "", F.struct(name.alias("name"), F.substr(part, F.lit(3)).cast("int").alias("part")))


def relative_path(path: Column, base: Column) -> Column:
    """The path below ``base`` when it lies there, else the path itself."""
    root = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))
    return F.when(path.startswith(root), F.substr(path, F.length(root) + 1)).otherwise(path)


def replace_prefix(path: Column, old: str, new: str) -> Column:
    """The path with its prefix exchanged; other paths unchanged."""
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(path)


def subtitle_format(path: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), path_ext(path))


def truthy(value: Column) -> Column:
    """Flags written as text."""
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes", "on"), F.lit(False))


def corrected_ms(seconds: Column, correction: Column) -> Column:
    """Seconds to ms with a correction of at most 0, not below 0."""
    return F.greatest(F.lit(0).cast("bigint"), seconds_to_ms(seconds) + F.least(F.lit(0), correction).cast("bigint"))


def end_offset(start: Column, duration: Column, tag: Column) -> Column:
    """Start (not below 0) plus duration, else the tagged duration."""
    return F.coalesce(F.greatest(start, F.lit(0)) + duration, tag)


def kept_start(path: Column, start: Column) -> Column:
    """The start of an input counts only in Matroska files, elsewhere it is 0."""
    return F.when(path_ext(path).isin("mkv", "mka", "mks", "mk3d", "webm"), start).otherwise(F.lit(0).cast("bigint"))


def sync_offset(wanted: Column, own: Column) -> Column:
    """Difference to apply, NULL when there is none."""
    return F.nullif(wanted - own, F.lit(0).cast("bigint"))


def cache_key(path: Column, size: Column, mtime: Column) -> Column:
    """First 16 hex digits of the hash that names a file's state."""
    return F.substring(F.sha2(F.concat_ws(":", path, size.cast("string"), mtime.cast("string")), 256), 1, 16)


def quoted_list(text: Column) -> Column:
    """Items of a list of double-quoted strings, with escaped quotes undone."""
    items = F.regexp_extract_all(text, F.lit('"((?:[^"\\\\]|\\\\.)*)"'), F.lit(1))
    return F.transform(items, lambda x: F.replace(x, F.lit('\\"'), F.lit('"')))


def compact_time(seconds: Column) -> Column:
    """1:02:03 or 2:03."""
    s = F.bround(seconds).cast("bigint")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def flac_format(fmt: Column) -> Column:
    """Sample format that FLAC can hold: 16 bits for formats of up to 16 bits, else 32."""
    return F.when(F.rtrim(fmt, F.lit("p")).isin("u8", "s16"), "s16").otherwise("s32")


def last_score(text: Column) -> Column:
    """The number after the last 'All:' of a report."""
    return F.regexp_extract(text, "(?s)^.*All:\\s*([0-9.]+)", 1).try_cast("double")


def within_ratio(x: Column, wanted: Column, tolerance: float = 0.05) -> Column:
    return F.abs(x - wanted) < wanted * tolerance


def keyword_language(text: Column) -> Column:
    """Language named beside a dubbing or audio keyword, or glued before it; NULL when none is."""
    low = F.lower(text)
    word = "(?:dubbing|dub|lektor|audio|lang|language)"
    after = F.regexp_extract_all(low, F.lit(f"(?U)\\b{word}\\W+([a-z]{{2,3}})\\b"), F.lit(1))
    before = F.regexp_extract_all(low, F.lit(f"(?U)\\b([a-z]{{2,3}})\\W+{word}\\b"), F.lit(1))
    glued = F.regexp_extract_all(low, F.lit("(?U)(?<![a-z])([a-z]{2,3})(?:dub|dubbing|lektor)(?![a-z])"), F.lit(1))
    known = F.filter(F.transform(F.concat(after, before, glued), lambda x: unify_language(x)), lambda x: x.isNotNull())
    return F.get(known, F.lit(0))


def token_language(label: Column) -> Column:
    """First word of a label that is a language: longer words by name, words of three letters by code; two letters don't count."""
    words = F.transform(F.regexp_extract_all(label, F.lit("[A-Za-z]{2,}"), F.lit(0)), lambda w: F.lower(w))
    named = F.transform(words, lambda w: F.when(F.length(w) >= 3, F.try_element_at(language_map(), w)))
    return F.get(F.filter(named, lambda x: x.isNotNull()), F.lit(0))


def label_language(name: Column, path: Column) -> Column:
    """Track name first, then the file's name."""
    return F.coalesce(keyword_language(name), token_language(name), keyword_language(path_stem(path)))


def balanced_any(conditions: list[Column]) -> Column:
    """One OR of many conditions as a balanced tree, so that deep plans don't arise."""
    if not conditions:
        return F.lit(False)
    while len(conditions) > 1:
        conditions = [reduce(lambda a, b: a | b, conditions[i : i + 2]) for i in range(0, len(conditions), 2)]
    return conditions[0]
