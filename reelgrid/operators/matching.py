"""Joins: prefix, positional, two-stage, distance with one-to-one assignment, nearest key."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's folder; where none is set, a local session (tests) uses a local one and a cluster raises."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if found is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="reelgrid-"))
    return df.checkpoint()


def prefix_longest(names: DataFrame, prefixes: DataFrame, name: str, prefix: str, on: list[str], tie: str) -> DataFrame:
    """Each name with the longest prefix (then the least ``tie``) that starts it in the same ``on`` group.

    Names are cut at every length that some prefix has, so the join is an
    equi-join, never a product.  Left join: names without a prefix keep NULLs.
    """
    sizes = prefixes.select(F.length(prefix).alias("_n")).distinct().agg(F.collect_set("_n").alias("_ns"))
    cut = F.transform(F.filter("_ns", lambda n: n <= F.length(name)), lambda n: F.substr(name, F.lit(1), n))
    probe = names.select(*on, name).distinct().crossJoin(F.broadcast(sizes)).select(*on, name, F.explode(cut).alias(prefix))
    hit = probe.join(prefixes, [*on, prefix])
    order = F.max_by(F.struct(prefix, tie), F.struct(F.length(prefix), -F.col(tie)))
    best = hit.groupBy(*on, name).agg(order.alias("_b")).select(*on, name, F.col("_b")[prefix].alias(prefix), F.col("_b")[tie].alias(tie))
    return names.join(best, [*on, name], "left")


def numbered(df: DataFrame, by: list[str], *order: Column | str, name: str = "pos") -> DataFrame:
    """Adds a running number within each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def zipped(left: DataFrame, right: DataFrame, by: list[str], order_l: list, order_r: list) -> DataFrame:
    """Row i of a group on one side with row i of the same group on the other; what has no partner stays, with NULLs (unequal counts are an error of the input)."""
    return numbered(left, by, *order_l).join(numbered(right, by, *order_r), [*by, "pos"], "full")


def ordinals(df: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """Running number over the whole table by a key without ties: ranges are numbered apart, then shifted by their offsets."""
    part = checkpointed(df.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id()))
    size = part.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return part.withColumn("_i", inside).join(size.select("_p", before.alias("_o")), "_p").withColumn(name, F.col("_i") + F.col("_o")).drop("_p", "_i", "_o")


def two_stage(left: DataFrame, right: DataFrame, key: str, lid: str, rid: str) -> DataFrame:
    """One-to-one match: by key where it is unique on both sides, the rest in order; (lid, rid, stage).

    When the sides differ in number, what is left over has the stage
    'unmatched' and NULL for its partner.
    """
    ul = left.groupBy(key).agg(F.count("*").alias("n"), F.min(lid).alias(lid)).where("n = 1").drop("n")
    ur = right.groupBy(key).agg(F.count("*").alias("n"), F.min(rid).alias(rid)).where("n = 1").drop("n")
    first = ul.join(ur, key).select(lid, rid, F.lit("key").alias("stage"))
    rest_l = ordinals(left.select(lid).join(first.select(lid), lid, "left_anti"), lid)
    rest_r = ordinals(right.select(rid).join(first.select(rid), rid, "left_anti"), rid)
    stage = F.when(F.col(lid).isNull() | F.col(rid).isNull(), "unmatched").otherwise("order")
    return first.unionByName(rest_l.join(rest_r, "pos", "full").select(lid, rid, stage.alias("stage")))


def sign_hash(vec: Column, lanes: int = 1, width: int = 64) -> list[Column]:
    """Sign bits of a vector, ``width`` bits a bigint."""
    out = []
    for k in range(lanes):
        part = F.slice(vec, k * width + 1, width)
        out.append(F.aggregate(F.transform(part, lambda x: (x > 0).cast("bigint")), F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(x)))
    return out


def hamming(a: list[Column], b: list[Column]) -> Column:
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total.cast("int")


def distance_pairs(left: DataFrame, right: DataFrame, lid: str, rid: str, lh: str, rh: str, most: int | None = None) -> DataFrame:
    """All pairs with their distance.

    With a bound ``most`` the hash is cut into ``most`` + 1 parts: two
    hashes within the bound agree in one part, so the join is on the parts
    and exact.  Without a bound every pair is wanted, and the product is the result itself.
    """
    d = F.bit_count(F.col(lh).bitwiseXOR(F.col(rh))).cast("int")
    if most is None:
        return left.select(lid, lh).crossJoin(right.select(rid, rh)).select(lid, rid, d.alias("distance"))
    if most >= 64:
        raise ValueError("a bound of 64 bits is no bound")
    ends = [i * 64 // (most + 1) for i in range(most + 2)]

    def cut(c: str) -> Column:
        bits = [F.shiftrightunsigned(c, a).bitwiseAND(F.lit((1 << (b - a)) - 1) if b - a < 64 else F.lit(-1)) for a, b in zip(ends, ends[1:], strict=False)]
        return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.cast("bigint").alias("v")) for i, v in enumerate(bits)]))

    both = left.select(lid, lh, cut(lh).alias("_p")).join(right.select(rid, rh, cut(rh).alias("_p")), "_p")
    return both.select(lid, rid, d.alias("distance")).where(F.col("distance") <= most).distinct()


def _nearest_of_block(key: tuple, rows: pa.Table) -> pa.Table:
    """Least distance from each row of side 0 to the rows of side 1, ties to the least id; strips bound the memory."""
    side, ids, h = (rows.column(c).to_numpy() for c in ("side", "id", "h"))
    left, right = (np.flatnonzero(side == k) for k in (0, 1))
    right = right[np.argsort(ids[right], kind="stable")]
    out = []
    for at in range(0, len(left) if len(right) else 0, 64):
        x = left[at : at + 64]
        d = np.bitwise_count((h[x][:, None] ^ h[right][None, :]).view(np.uint64))
        d[ids[x][:, None] == ids[right][None, :]] = 255
        best = d.argmin(axis=1)
        out.append((ids[x], d[np.arange(len(x)), best].astype(np.int32), ids[right][best]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, dtype=t) for t in (np.int64, np.int32, np.int64)]
    keep = cols[1] < 255
    return pa.table([pa.array(c[keep]) for c in cols], names=["id", "distance", "other"])


def nearest_other(rows: DataFrame, rid: str, h: str, block: int = 8192) -> DataFrame:
    """(rid, distance, other): each row with the nearest other row by Hamming distance, ties to the least id.

    Every pair is compared, in products of blocks of some ``block`` rows, so
    no task holds a whole side and no pair becomes a row.  Rows without a
    hash have no neighbour.
    """
    x = rows.select(F.col(rid).cast("bigint").alias("id"), F.col(h).alias("h")).where("id is not null and h is not null")
    n = -(-x.count() // block) or 1
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = x.select(F.lit(0).alias("side"), "id", "h", own.alias("i"), every.alias("j"))
    right = x.select(F.lit(1).alias("side"), "id", "h", every.alias("i"), own.alias("j"))
    found = left.unionByName(right).groupBy("i", "j").applyInArrow(_nearest_of_block, "id bigint, distance int, other bigint")
    return found.groupBy(F.col("id").alias(rid)).agg(F.min(F.struct("distance", "other")).alias("x")).select(rid, "x.distance", "x.other")


def greedy_pairs(pairs: DataFrame, lid: str, rid: str, distance: str) -> DataFrame:
    """Greedy one-to-one assignment in order of (distance, lid, rid).

    Each round takes the pairs that are best for both ends, which is what
    greedy would take, since the order has no ties; rounds go on until no
    pair is left.  Each round is checkpointed.  For pairs that are given; where
    all of two sides count, ``greedy_hashes`` makes no rows of them.
    """
    left = checkpointed(pairs.select(lid, rid, distance))
    out = None
    while not left.isEmpty():
        order = [distance, lid, rid]
        a = F.row_number().over(Window.partitionBy(lid).orderBy(*order))
        b = F.row_number().over(Window.partitionBy(rid).orderBy(*order))
        took = checkpointed(left.select("*", a.alias("_a"), b.alias("_b")).where("_a = 1 and _b = 1").drop("_a", "_b"))
        out = took if out is None else out.union(took)
        left = checkpointed(left.join(took.select(lid), lid, "left_anti").join(took.select(rid), rid, "left_anti").select(lid, rid, distance))
    return left if out is None else out


def _sides(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and hashes of side 0 and of side 1, in order of ids."""
    side, ids, h = (rows.column(c).to_numpy() for c in ("side", "id", "h"))
    parts = [np.flatnonzero(side == k) for k in (0, 1)]
    return [(ids[x], h[x].view(np.uint64)) for x in (p[np.argsort(ids[p], kind="stable")] for p in parts)]


def _best_of_block(key: tuple, rows: pa.Table) -> pa.Table:
    """The nearest row of the other side for each row of both sides, ties to the least id; strips bound the memory."""
    sides = _sides(rows)
    out = [[np.zeros(0, dtype=t)] for t in (np.int32, np.int64, np.int64, np.int32, np.int64)]
    for k in (0, 1):
        (ids, h), (others, g) = sides[k], sides[1 - k]
        for at in range(0, len(ids) if len(others) else 0, 64):
            x = h[at : at + 64]
            d = np.bitwise_count(x[:, None] ^ g[None, :])
            best = d.argmin(axis=1)
            for c, v in zip(out, (np.full(len(x), k), ids[at : at + 64], x.view(np.int64), d[np.arange(len(x)), best], others[best]), strict=True):
                c.append(v.astype(c[0].dtype))
    return pa.table([pa.array(np.concatenate(c)) for c in out], names=["side", "id", "h", "distance", "other"])


def _least(d: np.ndarray, owner: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances folded so that each owner (a sorted array) has one place, and these owners."""
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return (d, owner) if len(first) == len(owner) else (np.minimum.reduceat(d, first, axis=axis), owner[first])


def _greedy_of_rows(key: tuple, rows: pa.Table) -> pa.Table:
    """Greedy assignment over all rows in (distance, left, right) order, in memory that is linear in the rows.

    Each left id has a lower bound of its distance to what is free.  At
    distance d those with the bound d look, by rising id, for their least free
    right at d; who finds none takes the least distance seen as its bound.
    So an id is compared with the free rights once a distance, whatever ties
    there are; where an equal hash found none before it, it takes that one's bound.
    """
    (ids, h), (others, g) = _sides(rows)
    names, own = np.unique(ids, return_inverse=True)
    bound = np.zeros(len(names), dtype=np.uint8)
    kinds, kind = np.unique(h, return_inverse=True)
    lone = np.bincount(own, minlength=len(names))[own] == 1
    out: list[tuple[int, int, int]] = []
    for d in range(65):
        todo = np.flatnonzero(bound[own] == d)
        found = np.zeros(len(kinds), dtype=np.uint8)
        at = 0
        while at < len(todo) and len(g):
            end = min(at + max(1, min(256, (1 << 19) // len(g))), len(todo))
            end = int(np.searchsorted(own[todo], own[todo[end - 1]], "right"))
            strip, at = todo[at:end], end
            known = lone[strip] & (found[kind[strip]] > 0)
            bound[own[strip[known]]] = found[kind[strip[known]]]
            strip = strip[~known]
            if not len(strip):
                continue
            x, left = _least(np.bitwise_count(h[strip][:, None] ^ g[None, :]), own[strip], 0)
            x, right = _least(x, others, 1)
            took = []
            for k, i in enumerate(left):
                j = x[k].argmin()
                bound[i] = x[k, j]
                if bound[i] == d:
                    out.append((names[i], right[j], d))
                    took.append(right[j])
                    x[:, j] = bound[i] = 255
            if took:
                free = ~np.isin(others, took)
                others, g = others[free], g[free]
            strip = strip[lone[strip] & (bound[own[strip]] < 255)]
            found[kind[strip]] = bound[own[strip]]
    cols = zip(*out, strict=True) if out else ([], [], [])
    return pa.table([pa.array(np.array(c, dtype=t)) for c, t in zip(cols, (np.int64, np.int64, np.int32), strict=True)], names=["id", "other", "distance"])


def greedy_hashes(left: DataFrame, right: DataFrame, lid: str, rid: str, lh: str, rh: str, block: int = 8192, alone: int = 1 << 26) -> DataFrame:
    """``greedy_pairs`` over all pairs of two sides by Hamming distance; no pair becomes a row.

    A round finds the nearest of every row on both sides, in products of
    blocks of some ``block`` rows, takes the pairs that are best for both ends
    and is checkpointed.  When no more than ``alone`` pairs are left, or when
    ties let a round take less than a sixteenth of the smaller side, one task
    does the rest; it holds the rows left, not their pairs.  Rows without an
    id or a hash have no partner; an id with several hashes counts with the nearest.
    """
    rows = [x.select(F.lit(k).alias("side"), F.col(i).cast("bigint").alias("id"), F.col(h).alias("h")) for k, (x, i, h) in enumerate(((left, lid, lh), (right, rid, rh)))]
    rest = checkpointed(rows[0].union(rows[1]).where("id is not null and h is not null").groupBy("side", "id").agg(F.collect_set("h").alias("hs")))
    n = dict(rest.groupBy("side").agg(F.sum(F.size("hs"))).collect())
    n, took, out = [n.get(k, 0) for k in (0, 1)], max(n.values(), default=0), []
    every = rest.select("side", "id", F.explode("hs").alias("h"))
    while n[0] * n[1] > alone and took * 16 >= min(n):
        parts = [-(-k // block) for k in n]
        sent = []
        for k in (0, 1):
            own, other = F.pmod(F.xxhash64("id"), F.lit(parts[k])).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(parts[1 - k] - 1)))
            sent.append(every.where(F.col("side") == k).select("side", "id", "h", own.alias("ij"[k]), other.alias("ij"[1 - k])))
        found = sent[0].unionByName(sent[1]).groupBy("i", "j").applyInArrow(_best_of_block, "side int, id bigint, h bigint, distance int, other bigint")
        best = found.groupBy("side", "id").agg(F.min(F.struct("distance", "other")).alias("x"), F.collect_set("h").alias("hs"))
        ends = [F.when(F.col("side") == k, F.col("id")).otherwise(F.col("x.other")) for k in (0, 1)]
        seen = checkpointed(best.select("side", "id", "hs", "x.distance", "x.other", (F.count("*").over(Window.partitionBy(*ends)) == 2).alias("both")))
        size = F.when(~F.col("both"), F.size("hs"))
        *n, took = seen.agg(*[F.coalesce(F.sum(F.when(F.col("side") == k, size)), F.lit(0)) for k in (0, 1)], F.count(F.when(F.col("both") & (F.col("side") == 0), 1))).first()
        out.append(seen.where("both and side = 0").select("id", "other", "distance"))
        every = seen.where(~F.col("both")).select("side", "id", F.explode("hs").alias("h"))
    last = every.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_greedy_of_rows, "id bigint, other bigint, distance int")
    for x in out:
        last = last.union(x)
    return last.select(F.col("id").alias(lid), F.col("other").alias(rid), "distance")


def nearest_three(rows: DataFrame, keys: DataFrame, key: list[str], rid: str, at: str, key_at: str) -> DataFrame:
    """Each row (rid) of a group with the up to three rows of ``keys`` nearest to its ``at``, the earlier one on a tie.

    The keys are numbered; a row learns how many stand before it and joins
    the three on either side by their numbers.
    """
    k = keys.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(key_at)).cast("bigint"))
    both = rows.select(*key, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row"))
    both = both.union(keys.select(*key, F.col(key_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row")))
    n = F.sum(1 - F.col("_side")).over(Window.partitionBy(*key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0))
    near = both.withColumn("_n", n).where("_side = 1").select("_row.*", F.explode(F.sequence(F.col("_n") - 2, F.col("_n") + 3)).alias("_r"))
    rank = F.row_number().over(Window.partitionBy(*key, rid).orderBy(F.abs(F.col(key_at) - F.col(at)), key_at))
    return near.join(k, [*key, "_r"]).withColumn("_k", rank).where("_k <= 3").drop("_k", "_r")


def predicted_match(rows: DataFrame, keys: DataFrame, key: list[str], rid: str, at: str, key_at: str, distance: Column, most: float) -> DataFrame:
    """The pair of least ``distance`` of each row with the three keys nearest to its predicted place ``at``, if at most ``most``; ties to the earlier key.

    Predictions beyond the keys fall on the first or last three of them,
    so no clamp is needed.
    """
    tried = nearest_three(rows, keys, key, rid, at, key_at).withColumn("_d", distance)
    best = tried.groupBy(*key, rid).agg(F.min(F.struct(F.col("_d").alias("distance"), key_at)).alias("_b"))
    return best.select(*key, rid, F.col("_b.distance").alias("distance"), F.col(f"_b.{key_at}").alias(key_at)).where(F.col("distance") <= most)


def latest_before(rows: DataFrame, facts: DataFrame, key: list[str], at: str, fact_at: str, fact: str) -> DataFrame:
    """Each row with the last fact of its key strictly before it: one sort over both sides, no product."""
    a = rows.select(*key, F.col(at).alias("_t"), F.lit(0).alias("_side"), F.struct(*[F.col(c) for c in rows.columns]).alias("_row"), F.lit(None).cast(facts.schema[fact].dataType).alias("_fact"), F.lit(None).cast(facts.schema[fact_at].dataType).alias("_ft"))
    b = facts.select(*key, F.col(fact_at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(fact).alias("_fact"), F.col(fact_at).alias("_ft"))
    w = Window.partitionBy(*key).orderBy("_t", "_side", "_fact").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_side") == 1, F.struct("_ft", "_fact")), ignorenulls=True).over(w)
    return a.union(b).withColumn("_last", last).where("_side = 0").select("_row.*", F.col("_last._ft").alias(f"prev_{fact_at}"), F.col("_last._fact").alias(f"prev_{fact}"))


def nearest_key(rows: DataFrame, keys: DataFrame, key: list[str], at: str, key_at: str) -> DataFrame:
    """Each row with the nearest key of its group, the earlier one on a tie."""
    a = rows.select(*key, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast("bigint").alias("_k"))
    b = keys.select(*key, F.col(key_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(key_at).cast("bigint").alias("_k"))
    w = Window.partitionBy(*key).orderBy("_t", "_side")
    before = F.last("_k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_k", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    x = a.union(b).select("*", before.alias("_b"), after.alias("_a")).where("_side = 1")
    near = F.when(F.col("_b").isNull() | (F.col("_a") - F.col("_t") < F.col("_t") - F.col("_b")), F.col("_a")).otherwise(F.col("_b"))
    return x.select("_row.*", near.alias("nearest"))
