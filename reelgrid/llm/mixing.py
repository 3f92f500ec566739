"""Mixing sources to target weights by hierarchical budgeting.

The corpus is a tree: domain, language, source.  Each node's budget is
split among its children by weight, but no child gets more than its
capacity, which is its tokens times ``max_epochs``.  What a child can't use
goes to its siblings by weight; only when all of them are full does the
rest return to the parent's siblings, because the parent's own capacity is
the sum of its children's.  The split is the exact water level of each
family, found by sorting children by capacity over weight and taking
running sums, in whole numbers.

A leaf of budget q and t tokens takes q div t whole epochs and, of the
epoch after them, the prefix whose tokens sum to at most the remainder.
Each epoch has its own seeded order: md5 of seed, epoch and doc_id, then
doc_id.  The prefix is found by token sums of hash buckets and then within
the one bucket where the sum is passed, so no task holds a whole leaf.

A source's domain is that of the first of ``rules`` (pattern, domain) whose
pattern its name matches; a source that matches none has the first word of
its name as its domain, and 'unknown' where it has none.

Defined cases: NULL language or source is 'unknown'; languages, domains
and sources without a weight have weight 1; weights must be positive whole
numbers; NULL and empty texts have 0 tokens and come with every whole
epoch; rows with one doc_id enter a prefix together; rows of a leaf
without tokens are not taken; an empty table gives no rows.  Copies are repeated rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.llm.base import pick, place, positional, stored

LEAF = ["domain", "lang", "source"]


@dataclass(frozen=True)
class Params:
    seed: int = 20_240_501
    max_epochs: int = 2
    #: The whole budget as a share of the corpus' tokens, in thousandths.
    budget_thousandths: int = 900
    #: Hex digits of the hash that make a bucket.
    digits: int = 3
    #: Domains of the given tables' numbered sources, by last digit; other corpora bring their own rules.
    rules: tuple[tuple[str, str], ...] = (("[048]$", "web"), ("[159]$", "news"), ("[26]$", "books"), ("[37]$", "forum"))
    domains: dict[str, int] = field(default_factory=lambda: {"web": 4, "news": 3, "books": 2, "forum": 1})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 6, "fr": 2, "de": 2, "es": 1})
    sources: dict[str, int] = field(default_factory=dict)


def domain_of(source: Column, p: Params) -> Column:
    """Domain of a source."""
    word = F.regexp_extract(source, "^[^A-Za-z0-9]*([A-Za-z0-9]+)", 1)
    out = F.when(word == "", "unknown").otherwise(F.lower(word))
    for pattern, domain in reversed(p.rules):
        out = F.when(source.rlike(pattern), domain).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """Tokens between blanks."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("bigint")


def _weight(name: Column, weights: dict[str, int]) -> Column:
    if any(w != int(w) or w < 1 for w in weights.values()):
        raise ValueError("weights must be positive whole numbers")
    out = F.lit(1)
    for k, w in sorted(weights.items()):
        out = F.when(name == k, int(w)).otherwise(out)
    return out.cast("bigint")


def _split(nodes: DataFrame, parent: list[str], budget: str, key: str) -> DataFrame:
    """Adds each node's share of its parent's budget: its water level."""
    d = lambda c: c.cast("decimal(38,0)")
    w = Window.partitionBy(*parent)
    o = w.orderBy(F.col("cap").cast("double") / F.col("weight"), key)
    zero = F.lit(0).cast("decimal(38,0)")
    before = F.coalesce(F.sum(d(F.col("cap"))).over(o.rowsBetween(Window.unboundedPreceding, -1)), zero)
    after = F.sum(d(F.col("weight"))).over(o.rowsBetween(0, Window.unboundedFollowing))
    full = d(d(F.col("cap")) * d(after)) <= d(d(F.col("weight")) * (d(F.col(budget)) - d(before)))
    marked = nodes.withColumn("full", full)
    used = F.sum(F.when(F.col("full"), d(F.col("cap"))).otherwise(zero)).over(w)
    open_ = F.sum(F.when(F.col("full"), zero).otherwise(d(F.col("weight")))).over(w)
    share = F.expr("(cast(weight * left as decimal(38,0))) div open")
    out = marked.withColumn("left", d(F.col(budget)) - d(used)).withColumn("open", d(open_))
    out = out.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(share).cast("bigint"))
    return out.drop("full", "left", "open")


def slim(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, domain, lang, source, tokens) of every row."""
    rows = pick(docs, doc_id="doc_id:bigint", text="text", lang="lang", source="source")
    src = F.coalesce("source", F.lit("unknown"))
    return rows.select("doc_id", domain_of(src, p).alias("domain"), F.coalesce("lang", F.lit("unknown")).alias("lang"), src.alias("source"), tokens_of(F.col("text")).alias("tokens"))


def budgets(rows: DataFrame, p: Params) -> DataFrame:
    """(domain, lang, source, tokens, quota) of every leaf that has tokens."""
    leaf = rows.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    leaf = leaf.withColumn("cap", F.col("tokens") * p.max_epochs).withColumn("weight", _weight(F.col("source"), p.sources))
    lang = leaf.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(F.col("lang"), p.langs))
    dom = lang.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(F.col("domain"), p.domains))
    total = leaf.agg(F.sum("tokens").alias("all"), F.sum("cap").alias("most"))
    root = total.select(F.least(F.expr(f"all * {p.budget_thousandths} div 1000"), "most").alias("budget"))
    dom = _split(dom.crossJoin(F.broadcast(root)).withColumn("root", F.lit(0)), ["root"], "budget", "domain")
    lang = _split(lang.join(dom.select("domain", F.col("share").alias("budget")), "domain"), ["domain"], "budget", "lang")
    up = lang.select("domain", "lang", F.col("share").alias("budget"))
    return _split(leaf.join(up, ["domain", "lang"]), ["domain", "lang"], "budget", "source").select(*LEAF, "tokens", F.col("share").alias("quota"))


def _hash(p: Params) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(p.seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def plan(rows: DataFrame, p: Params) -> DataFrame:
    """For every leaf: whole epochs, and the last hash and doc_id of the prefix of the next epoch (``past`` NULL: none)."""
    leaf = stored(budgets(rows, p).select(*LEAF, F.expr("quota div tokens").alias("whole"), F.expr("quota % tokens").alias("rest")))
    part = rows.join(leaf.where("rest > 0"), LEAF).withColumn("h", _hash(p)).withColumn("bucket", F.substring("h", 1, p.digits))
    sums = part.groupBy(*LEAF, "rest", "bucket").agg(F.sum("tokens").alias("sum"))
    upto = F.sum("sum").over(Window.partitionBy(*LEAF).orderBy("bucket"))
    at = sums.withColumn("upto", upto).where("upto > rest").groupBy(*LEAF).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("sum")).alias("before"))).alias("x")).select(*LEAF, F.col("x.bucket").alias("bucket"), F.col("x.before").alias("before"))
    at = stored(at)
    inside = part.join(at, [*LEAF, "bucket"])
    run = F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEAF, "bucket").orderBy("h", "doc_id"))
    last = inside.withColumn("run", run).where("run <= rest").groupBy(*LEAF).agg(F.max(F.struct("h", "doc_id")).alias("x"))
    last = last.select(*LEAF, F.col("x.h").alias("h"), F.col("x.doc_id").alias("id"))
    ends = at.join(last, LEAF, "left").select(*LEAF, F.coalesce("h", "bucket").alias("past"), F.col("id").alias("past_id"))
    return stored(leaf.join(ends, LEAF, "left").drop("rest"))


def _epochs(p: Params) -> Column:
    """Epochs a row is taken in."""
    h = _hash(p)
    inside = (h < F.col("past")) | ((h == F.col("past")) & (F.coalesce("doc_id", F.lit(-(2**63))) <= F.coalesce("past_id", F.lit(-(2**63)))))
    count = F.col("whole") + F.when(inside, 1).otherwise(0)
    return F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1)))


def mixture(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, epoch): every row that is taken, once an epoch."""
    rows = stored(slim(docs, params))
    got = rows.join(plan(rows, params), LEAF)
    return got.select("doc_id", *LEAF, "tokens", _epochs(params).alias("epoch"))


def mixed(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The taken rows with all their columns, repeated for each epoch; only the plan's few leaves meet the texts."""
    flat = positional(docs)
    src = F.coalesce(F.col(f"_{place(docs, 'source')}"), F.lit("unknown"))
    keyed = flat.withColumn("doc_id", F.col(f"_{place(docs, 'doc_id')}").cast("bigint")).withColumn("source", src)
    keyed = keyed.withColumn("domain", domain_of(F.col("source"), params)).withColumn("lang", F.coalesce(F.col(f"_{place(docs, 'lang')}"), F.lit("unknown")))
    got = keyed.join(plan(stored(slim(docs, params)), params), LEAF)
    return got.select(*flat.columns, _epochs(params).alias("epoch")).drop("epoch").toDF(*docs.columns)


def oracle(p: Params = Params()) -> str:
    """The same rows in DuckDB SQL."""

    def weight(c: str, ws: dict[str, int]) -> str:
        return f"CAST(CASE {c} {' '.join(f"WHEN '{k}' THEN {w}" for k, w in ws.items())} ELSE 1 END AS BIGINT)" if ws else "CAST(1 AS BIGINT)"

    def split(out: str, src: str, parent: str, key: str) -> str:
        return f"""
        {out}_1 AS (SELECT *, CAST(cap AS HUGEINT) * sum(weight) OVER (PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / weight, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            <= CAST(weight AS HUGEINT) * (budget - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full FROM {src}),
        {out} AS (SELECT * EXCLUDE (is_full, budget), CASE WHEN is_full THEN CAST(cap AS HUGEINT) ELSE
            (CAST(weight AS HUGEINT) * (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {parent}))) // nullif(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {parent}), 0) END AS share FROM {out}_1)"""

    rules = " ".join(f"WHEN regexp_matches(source, '{pattern}') THEN '{domain}'" for pattern, domain in p.rules)
    return f"""
    WITH r AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
            CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS BIGINT) AS tokens FROM documents),
        d AS (SELECT *, CASE {rules} WHEN regexp_extract(source, '[A-Za-z0-9]+') = '' THEN 'unknown' ELSE lower(regexp_extract(source, '^[^A-Za-z0-9]*([A-Za-z0-9]+)', 1)) END AS domain FROM r),
        leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {p.max_epochs} AS BIGINT) AS cap, {weight("source", p.sources)} AS weight
            FROM d GROUP BY ALL HAVING sum(tokens) > 0),
        lng AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap, {weight("lang", p.langs)} AS weight FROM leaf GROUP BY domain, lang),
        dom AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, {weight("domain", p.domains)} AS weight FROM lng GROUP BY domain),
        top AS (SELECT dom.*, 0 AS root, (SELECT least(sum(tokens) * {p.budget_thousandths} // 1000, sum(cap)) FROM leaf) AS budget FROM dom),
        {split("dom_s", "top", "root", "domain")},
        lng_b AS (SELECT lng.*, dom_s.share AS budget FROM lng JOIN dom_s USING (domain)),
        {split("lng_s", "lng_b", "domain", "lang")},
        leaf_b AS (SELECT leaf.*, lng_s.share AS budget FROM leaf JOIN lng_s USING (domain, lang)),
        {split("leaf_s", "leaf_b", "domain, lang", "source")},
        q AS (SELECT d.doc_id, d.domain, d.lang, d.source, d.tokens, leaf_s.share // leaf_s.tokens AS whole, leaf_s.share % leaf_s.tokens AS rest
            FROM d JOIN leaf_s ON d.domain = leaf_s.domain AND d.lang = leaf_s.lang AND d.source = leaf_s.source),
        h AS (SELECT *, md5('{p.seed}-' || whole || '-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM q),
        s AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM h),
        n AS (SELECT *, CAST(whole AS BIGINT) + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM s)
    SELECT doc_id, domain, lang, source, tokens, CAST(unnest(range(0, times)) AS BIGINT) AS epoch FROM n"""
