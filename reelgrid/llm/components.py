"""Groups of similar items from shared buckets, and connected components.

No step gathers a bucket, a hub or a group of copies into one row: members
stay rows, a bucket's figures are window aggregates that spill, and stars
join each link with its node's least neighbour.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.llm.base import cut, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour of a node to the least id in sight of that node."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.greatest("a", "b"), F.least("a", "b"))
    both = both.toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = (both.where("v > u") if large else both).join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return (out if large else out.union(least)).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of the pairs (a, b); root is the least id of the component.

    Rounds go on until the set of links no longer changes; each round is
    checkpointed, so a lost executor costs one round at most.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        now = cut(_stars(_stars(now, True), False))
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
        seen = sign


def shared_buckets(members: DataFrame) -> DataFrame:
    """(bucket, id, first, weight) of the members (bucket, id) of buckets that hold two ids or more.

    ``first`` is the bucket's least id.  Of buckets with the same members,
    told by their number, least id and two sums of hashes, only one stays,
    with the number of such buckets as ``weight``.
    """
    w, h = Window.partitionBy("bucket"), F.xxhash64("id")
    wide = members.select("bucket", "id", F.count("*").over(w).alias("n"), F.min("id").over(w).alias("first"), F.bit_xor(h).over(w).alias("x"), F.sum(F.pmod(h, F.lit((1 << 31) - 1))).over(w).alias("s"))
    alike = Window.partitionBy("n", "first", "x", "s")
    once = wide.where("n > 1").withColumn("least", F.min("bucket").over(alike)).withColumn("weight", F.count_if(F.col("id") == F.col("first")).over(alike))
    return stored(once.where("bucket = least").select("bucket", "id", "first", "weight"))


def rare_members(hot: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """(bucket, feature, id, root): each member under its rarest features within its bucket.

    hot: (bucket, id, root); features: (id, feature, n), the distinct
    features of a set of n.  Two sets whose Jaccard similarity reaches the
    threshold share one of the first n - ceil(threshold n) + 1 features of
    either in any common order, so no such pair of a bucket is lost, and
    what all members of a bucket share no longer pairs them.
    """
    known = hot.join(features.hint("merge"), "id")
    often = known.groupBy("bucket", "feature").agg(F.count("*").alias("often"))
    order = Window.partitionBy("bucket", "id").orderBy("often", "feature")
    known = known.join(often.hint("merge"), ["bucket", "feature"]).withColumn("at", F.row_number().over(order))
    least = F.ceil(F.col("n") * F.lit(threshold) - 1e-9)
    return known.where((F.col("at") <= F.col("n") - least + 1) & (F.col("often") > 1)).select("bucket", "feature", "id", "root")


def _across(member: DataFrame, on: list[str]) -> DataFrame:
    """(x, y, weight): members of one bucket that are of different components, each pair once a bucket."""
    x = member.select(*on, F.col("id").alias("x"), F.col("root").alias("rx"), "weight")
    y = member.select(*on, F.col("id").alias("y"), F.col("root").alias("ry"))
    return x.join(y.hint("merge"), on).where("rx < ry").select("x", "y", "weight")


def linked(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], refine: Callable[[DataFrame], DataFrame], also: DataFrame, spread: int = 64) -> DataFrame:
    """(id, root) of the groups that pairs from the buckets make, once verified.

    buckets: as ``shared_buckets`` gives them; verify: keeps the true ones of
    pairs (a, b, met), met being the weight of the buckets that they share,
    or NULL where it isn't counted; also: pairs known to be true.  First
    each id is paired with one id: of the first ids of its buckets, the one
    it meets most often; then, across the components so found, all pairs of
    a bucket are tried.  What the first pairs meet counts only the buckets
    that one of them leads, so it chooses but can't prune.  A pair within one
    component can't change the groups, so the result is that of all pairs.

    A bucket that still has more than ``spread`` pairs a member is not
    crossed: refine gives its members (bucket, id, root) as
    (bucket, feature, id, root) so that every true pair shares a feature.
    """
    firsts = buckets.where("id <> first").groupBy(F.col("first").alias("a"), F.col("id").alias("b")).agg(F.sum("weight").alias("met"))
    best = firsts.groupBy("b").agg(F.max(F.struct("met", (-F.col("a")).alias("a"))).alias("x"))
    leads = cut(best.select((-F.col("x.a")).alias("a"), "b", F.lit(None).cast("bigint").alias("met")))
    links = verify(leads).select("a", "b")
    member = buckets.select("bucket", "id", "weight").join(components(links.union(also.select("a", "b"))).hint("merge"), "id", "left")
    member = stored(member.select("bucket", "id", "weight", F.coalesce("root", "id").alias("root")))
    parts = member.groupBy("bucket", "root").agg(F.count("*").cast("double").alias("n")).groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    live = stored(member.join(parts.where("parts > 1").select("bucket", ((F.col("n") * F.col("n") - F.col("own")) / 2 > F.col("n") * spread).alias("hot")).hint("merge"), "bucket"))
    cross = _across(live.where("not hot"), ["bucket"])
    hot = live.where("hot").select("bucket", "id", "root")
    if not hot.isEmpty():
        cross = cross.union(_across(refine(hot).withColumn("weight", F.lit(None).cast("bigint")), ["bucket", "feature"]))
    met = F.when(F.count("weight") == F.count("*"), F.sum("weight")).alias("met")
    rest = cross.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(met)
    rest = rest.join(leads.select("a", "b"), ["a", "b"], "left_anti")
    return components(links.union(verify(rest).select("a", "b")).union(also.select("a", "b")))


def joined(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, id, several): the node of every document; prints: (doc_id, f1, f2); nodes: (f1, f2, id, top)."""
    own = nodes.select("f1", "f2", "id", (F.col("top") > F.col("id")).alias("several"))
    return stored(prints.select("doc_id", "f1", "f2").distinct().join(own.hint("merge"), ["f1", "f2"]).select("doc_id", "id", "several"))


def torn(member: DataFrame) -> DataFrame:
    """(a, b): nodes that hold different texts of one document."""
    ends = member.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("top")).where("b < top")
    return cut(member.join(ends.hint("merge"), "doc_id").select(F.col("id").alias("a"), "b").where("a <> b").distinct())


def grouped(member: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, group_id) of the documents that aren't alone; member as ``joined`` gives it."""
    out = member.join(roots.hint("merge"), "id", "left").where("several or root is not null")
    return out.select("doc_id", F.coalesce("root", "id").alias("group_id")).distinct()
