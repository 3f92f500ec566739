"""Elections: the best record of a group, priority orders, acceptance rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def priority_rank(value: Column, wanted: list[str]) -> Column:
    """Place in a priority list; NULL comes after the list, unlisted values after NULL."""
    at = F.array_position(F.array(*map(F.lit, wanted)), F.coalesce(value, F.lit("")))
    return F.when(value.isNull(), len(wanted) + 1).when(at > 0, at).otherwise(len(wanted) + 2).cast("int")


def elected(rows: DataFrame, key: list[str], source: str, better: list[Column], tie: Column, forced: Column | None = None, all_compete: bool = False) -> DataFrame:
    """All rows of the winning source of each key.

    A source with more rows of the key than any other wins outright;
    otherwise the sources with most rows (all of them with
    ``all_compete``) compete on their best row by ``better``, NULLs last,
    then the smallest ``tie``.  A key with rows where ``forced`` holds keeps
    those rows, of whatever source, and no others.
    """
    rows = rows.select("*", F.coalesce(forced if forced is not None else F.lit(False), F.lit(False)).alias("_forced"))
    n = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*key, source)))
    w = Window.partitionBy(*key)
    n = n.withColumn("_most", F.max("_n").over(w))
    lead = F.lit(0) if all_compete else F.when(F.col("_n") == F.col("_most"), 0).otherwise(1)
    order = [F.col("_forced").desc(), lead, *[c.desc_nulls_last() for c in better], tie.asc()]
    first = F.first(F.struct(F.col(source).alias("source"), "_forced")).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    won = F.when(F.col("_first._forced"), F.col("_forced")).otherwise(F.col(source).eqNullSafe(F.col("_first.source")))
    return n.withColumn("_first", first).where(won).withColumn("entries", F.col("_n").cast("bigint")).drop("_n", "_most", "_first", "_forced")


def best_of(rows: DataFrame, key: list[str], pick: list[str], *rank: Column) -> DataFrame:
    """The one row of each key that is largest by ``rank``."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*pick), F.struct(*rank)).alias("_b")).select(*key, "_b.*")


def duplicates(rows: DataFrame, key: list[str], distinct: str) -> DataFrame:
    """Keys that occur more than once and, each time, under another ``distinct`` value."""
    g = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(distinct).alias("places"))
    return g.where("n > 1").withColumn("valid", F.col("n") == F.col("places"))


def length_mismatch(base: Column, other: Column) -> Column:
    """Exact inequality; NULL never mismatches."""
    return F.coalesce(base != other, F.lit(False))


def first_issue(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule that is broken, NULL when none is."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(out)
    return out


def accepted(expected: DataFrame, found: DataFrame, key: list[str], count: str, short_ms: Column, tail_ms: Column) -> DataFrame:
    """Whether found counts equal the expected ones and neither end is too early (one-sided tolerances)."""
    j = expected.join(found, key, "left")
    return j.select(*key, ((F.col(f"expected_{count}") == F.coalesce(F.col(f"found_{count}"), F.lit(0))) & F.coalesce(short_ms <= 1000, F.lit(True)) & F.coalesce(tail_ms <= 250, F.lit(True))).alias("accepted"))


def with_ancestors(rows: DataFrame, path: str) -> DataFrame:
    """Every ancestor of each path, itself included, with its depth."""
    parts = F.split(path, "/")
    depth = F.explode(F.sequence(F.lit(1), F.size(parts)))
    return rows.select("*", depth.alias("depth")).withColumn("ancestor", F.concat_ws("/", F.slice(parts, F.lit(1), F.col("depth"))))


def nearest_metadata(rows: DataFrame, meta: DataFrame, path: str) -> DataFrame:
    """Metadata (path, key, value) of each row from its nearest ancestor that has any."""
    up = with_ancestors(rows.select(path).distinct(), path)
    have = meta.select(F.col("path").alias("ancestor")).distinct()
    near = up.join(have, "ancestor").groupBy(path).agg(F.max_by("ancestor", "depth").alias("ancestor"))
    return rows.join(near, path, "left").join(meta.withColumnRenamed("path", "ancestor"), "ancestor", "left")


def highest_passing(scores: DataFrame, key: list[str], x: str, score: str, target: float) -> DataFrame:
    """Largest x whose score meets the target, for scores that fall with x; NULL scores fail."""
    return scores.groupBy(*key).agg(F.max(F.when(F.col(score) >= target, F.col(x))).alias("best"))


def mean_quality(q: Column) -> Column:
    """Aggregate: mean without NULLs and zeros, 0 when nothing is left."""
    return F.coalesce(F.avg(F.nullif(q, F.lit(0.0))), F.lit(0.0))


def rich(rows: DataFrame, key: list[str], value: str, low: float, high: float, least: float = 3.5) -> DataFrame:
    """Keys whose values have an entropy above ``least``."""
    return entropy(rows, key, value, low, high).where(F.col("entropy") > least)


def entropy(rows: DataFrame, key: list[str], value: str, low: float, high: float, bins: int = 256) -> DataFrame:
    """Shannon entropy (natural logarithm) of the histogram of ``value``."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / ((high - low) / bins)))).cast("int")
    n = rows.groupBy(*key, b.alias("_bin")).agg(F.count("*").alias("_n"))
    p = F.col("_n") / F.sum("_n").over(Window.partitionBy(*key))
    return n.select(*key, p.alias("_p")).groupBy(*key).agg((-F.sum(F.col("_p") * F.ln("_p"))).alias("entropy"))
