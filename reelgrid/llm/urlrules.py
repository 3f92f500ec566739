"""URL filters by association rules.

A URL is a set of tokens, each marked by its part: scheme, host, path,
query key, query value.  Labelled URLs (those whose document number has a
label) are transactions, with one more item when the label is bad.
FP-growth mines the frequent sets; a rule 'tokens -> bad' stays when its
support, confidence and certainty reach the limits and no rule of a subset
of its tokens is as confident.  Certainty is the part of the way from the
base rate of bad labels to 1 that the confidence covers, so tokens that
most URLs have make no rule however many labels are bad.  Rules match by an inverted index: each is filed
under its rarest token, a URL looks up its tokens and a found rule fires
when all its tokens are there.

Defined cases: NULL and empty URLs have no tokens and stay; tokens of
digits alone are left out (they name one document); URLs without a
document number are not trained on; of several labels of a document the
worst counts; repeated rows count and are decided each for itself; empty
tables, or labels without a bad one or without a good one, give no rules
and every page stays; of rules with equal confidence and support the least
tokens come first; very long URLs are treated whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.llm.base import pick, stored

BAD = "label:bad"


@dataclass(frozen=True)
class Params:
    #: Share of labelled URLs that must have a rule's tokens and the bad label.
    support: float = 0.002
    #: Labelled bad URLs that a rule needs at least, however few are labelled.
    hits: int = 10
    confidence: float = 0.4
    #: Least (confidence - base) / (1 - base), where base is the share of bad labels.
    certainty: float = 0.2


def url_tokens(url: Column) -> Column:
    """Distinct marked tokens of a URL."""
    low = F.lower(url)
    query = F.regexp_extract(low, "\\?([^#]*)", 1)

    def words(text: Column, mark: str) -> Column:
        kept = F.filter(F.split(text, "[^\\p{L}\\p{N}]+"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
        return F.transform(kept, lambda x: F.concat(F.lit(mark), x))

    pairs = F.split(query, "&")
    keys = F.concat_ws(" ", F.transform(pairs, lambda x: F.split_part(x, F.lit("="), F.lit(1))))
    values = F.concat_ws(" ", F.transform(pairs, lambda x: F.split_part(x, F.lit("="), F.lit(2))))
    parts = [
        words(F.regexp_extract(low, "^([a-z][a-z0-9+.-]*)://", 1), "s:"),
        words(F.regexp_extract(low, "^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)", 1), "h:"),
        words(F.regexp_extract(low, "^(?:[a-z][a-z0-9+.-]*://)?[^/?#]*([^?#]*)", 1), "p:"),
        words(keys, "k:"),
        words(values, "v:"),
    ]
    return F.coalesce(F.array_distinct(F.concat(*parts)), F.array().cast("array<string>"))


def document_of(url: Column) -> Column:
    """The document number in a URL's path."""
    return F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*/[^?#]*?([0-9]+)(?:[^0-9?#][^?#/]*)?/?(?:[?#]|$)", 1).try_cast("bigint")


def transactions(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(items) of every labelled URL that has tokens."""
    urls = pick(pages, url="url").where("url is not null").select(url_tokens(F.col("url")).alias("items"), document_of(F.col("url")).alias("doc_id"))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    worst = pick(labels, doc_id="doc_id:bigint", quality="quality:int", toxic="toxic:int").where("doc_id is not null").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    known = urls.where("doc_id is not null and size(items) > 0").join(worst, "doc_id")
    return known.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))


def mine(pages: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """(rule, items, confidence, support) of the rules that stay; ``rule`` counts from 1 by confidence."""
    rows = stored(transactions(pages, labels))
    schema = "rule int, items array<string>, confidence double, support double"
    if rows.isEmpty():
        return pages.sparkSession.createDataFrame([], schema)
    total, bad = rows.agg(F.count("*"), F.count_if(F.array_contains("items", BAD))).first()
    base = bad / total
    least = min(1.0, max(params.support, params.hits / total))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=params.confidence).fit(rows)
    sets = stored(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    with_bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("hits"))
    rules = with_bad.join(sets, "items").select("items", (F.col("hits") / F.col("freq")).alias("confidence"), (F.col("hits") / F.lit(total)).alias("support"))
    rules = stored(rules.where((F.col("confidence") >= params.confidence) & (F.col("confidence") - base >= params.certainty * (1 - base)) & F.lit(bad < total)))
    less = rules.select(F.col("items").alias("few"), F.col("confidence").alias("sure"))
    more = rules.select("items", "confidence", F.explode("items").alias("token"))
    beaten = more.join(less.withColumn("token", F.col("few")[0]), "token").where((F.size("few") < F.size("items")) & (F.size(F.array_except("few", "items")) == 0) & (F.col("sure") >= F.col("confidence")))
    kept = rules.join(beaten.select("items").distinct(), "items", "left_anti")
    order = Window.orderBy(F.col("confidence").desc(), F.col("support").desc(), "items")
    return stored(kept.select(F.row_number().over(order).alias("rule"), "items", "confidence", "support"))


def indexed(rules: DataFrame) -> DataFrame:
    """Rules filed under their rarest token among the rules."""
    token = rules.select("rule", F.explode("items").alias("token"))
    often = token.groupBy("token").count()
    first = token.join(often, "token").groupBy("rule").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    return stored(rules.join(first, "rule"))


def decisions(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, rules, confidence, drop) of every page: the rules that fire and the best confidence."""
    rows = pick(pages, page_id="page_id:bigint", url="url").select("page_id", "url", url_tokens(F.col("url")).alias("have"))
    index = indexed(rules).select("token", "rule", "items", "confidence")
    probe = rows.select("url", "have").where("url is not null").distinct().select("url", "have", F.explode("have").alias("token"))
    fired = probe.join(index, "token").where(F.size(F.array_except("items", "have")) == 0)
    best = fired.groupBy("url").agg(F.array_sort(F.collect_set("rule")).alias("rules"), F.max("confidence").alias("confidence"))
    none = F.array().cast("array<int>")
    out = rows.drop("have").join(best, "url", "left")
    return out.select("page_id", "url", F.coalesce("rules", none).alias("rules"), F.round("confidence", 9).alias("confidence"), F.col("rules").isNotNull().alias("drop"))
