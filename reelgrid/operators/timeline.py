"""Analysis of matched pairs on two time-lines: ratios, deficits, outliers, fits, coverage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def steps(pairs: DataFrame, key: list[str], lhs: str, rhs: str, *tie: str) -> DataFrame:
    """Every pair with its successor: ``dl``, ``dr`` are the steps on either side (NULL at the end)."""
    w = Window.partitionBy(*key).orderBy(lhs, rhs, *tie)
    nl, nr = F.lead(lhs).over(w), F.lead(rhs).over(w)
    return pairs.select("*", nl.alias("next_l"), nr.alias("next_r"), (nl - F.col(lhs)).alias("dl"), (nr - F.col(rhs)).alias("dr"))


def ratio_median(pairs: DataFrame, key: list[str], lhs: str, rhs: str) -> DataFrame:
    """Median of the step ratios dl / dr; steps with dr = 0 don't count; NaN when none does."""
    s = steps(pairs, key, lhs, rhs)
    r = F.when(F.col("dr") != 0, F.col("dl") / F.col("dr"))
    return s.groupBy(*key).agg(F.count(r).alias("n"), F.coalesce(F.median(r), F.lit(float("nan"))).alias("ratio"))


def gap_deficits(pairs: DataFrame, key: list[str], lhs: str, rhs: str, floor: float = 2000.0, share: float = 0.02) -> DataFrame:
    """Gaps whose right step misses what the median slope predicts by more than max(floor, share of the gap)."""
    s = steps(pairs, key, lhs, rhs).where("dl is not null")
    slope = s.where("dl > 0").groupBy(*key).agg(F.median(F.col("dr") / F.col("dl")).alias("slope"), F.count("*").alias("n")).where("n >= 2")
    miss = F.bround(F.col("dl") * F.col("slope") - F.col("dr")).cast("bigint")
    out = s.join(slope, key).withColumn("deficit", miss)
    return out.where(F.abs("deficit") > F.greatest(F.lit(floor), F.col("dl") * share)).select(*key, F.col(lhs).alias("l0"), F.col("next_l").alias("l1"), F.col(rhs).alias("r0"), F.col("next_r").alias("r1"), "deficit")


def mad_filter(rows: DataFrame, key: list[str], value: str, factor: float = 1.5) -> DataFrame:
    """Rows whose value is at most median + factor * MAD of their group; groups of up to three stay whole."""
    med = rows.groupBy(*key).agg(F.median(value).alias("_med"), F.count("*").alias("_n"))
    x = rows.join(med, key)
    mad = x.groupBy(*key).agg(F.median(F.abs(F.col(value) - F.col("_med"))).alias("_mad"))
    return x.join(mad, key).where((F.col("_n") <= 3) | (F.col(value) <= F.col("_med") + factor * F.col("_mad"))).drop("_med", "_n", "_mad")


def cutoff(value: Column, sigmas: float = 2.0, floor: float = 16.0) -> Column:
    """Aggregate: median + sigmas * population deviation, not under the floor (which stands in for no rows)."""
    return F.greatest(F.coalesce(F.median(value) + sigmas * F.stddev_pop(value), F.lit(floor)), F.lit(floor))


def coverage(pairs: DataFrame, key: list[str], lhs: str, rhs: str, l_end: Column, r_end: Column, step: float, frames: float = 2.0) -> DataFrame:
    """Edge gaps on both sides, covered share, and whether each edge misses at most ``frames`` steps."""
    first, last = F.min(F.struct(lhs, rhs)), F.max(F.struct(lhs, rhs))
    g = pairs.groupBy(*key).agg(first.alias("f"), last.alias("t"), F.max(l_end).alias("le"), F.max(r_end).alias("re"))
    lg, rg = F.col("f")[lhs], F.col("f")[rhs]
    lt, rt = F.col("le") - F.col("t")[lhs], F.col("re") - F.col("t")[rhs]
    full = (F.greatest(lg, rg) <= frames * step) & (F.greatest(lt, rt) - step <= frames * step)
    share = (F.col("t")[lhs] - lg) / F.nullif(F.col("le"), F.lit(0))
    return g.select(*key, lg.alias("l_head"), rg.alias("r_head"), lt.alias("l_tail"), rt.alias("r_tail"), share.alias("share"), full.alias("full_coverage"))


def constant_offset(rows: DataFrame, key: list[str], lhs: str, rhs: str, most: float = 1.0) -> DataFrame:
    """Deviation and rounded median of rhs - lhs, and whether the offset is constant."""
    d = F.col(rhs) - F.col(lhs)
    out = rows.groupBy(*key).agg(F.stddev_pop(d).alias("sigma"), F.bround(F.median(d)).cast("bigint").alias("offset"), F.count("*").alias("n"))
    return out.withColumn("constant", F.col("sigma") <= most)


def grid_shift(rows: DataFrame, key: list[str], delta: Column, step: float) -> DataFrame:
    """Median shift, taken only within a quarter step of a whole number of steps, else 0."""
    m = rows.groupBy(*key).agg(F.median(delta).alias("m"))
    off = F.abs(F.col("m") - F.bround(F.col("m") / step) * step)
    return m.select(*key, F.when(off <= step / 4, F.bround("m")).otherwise(0).cast("bigint").alias("shift"))


def linear_fit(rows: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line by group with the median and 95th percentile of its residuals."""
    fit = rows.groupBy(*key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), (F.max(x) - F.min(x)).alias("span"))
    res = F.abs(F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept")))
    return rows.join(fit, key).groupBy(*key, "slope", "intercept", "span").agg(F.median(res).alias("res_median"), F.percentile(res, 0.95).alias("res_p95"))


def linear_mapping(rows: DataFrame, key: list[str], lhs: str, rhs: str, most: float) -> DataFrame:
    """Slope of the line through a group's first and last pair, NULL when it isn't positive or a pair lies more than ``most`` off."""
    ends = rows.groupBy(*key).agg(F.min(F.struct(lhs, rhs)).alias("f"), F.max(F.struct(lhs, rhs)).alias("t"))
    slope = (F.col("t")[rhs] - F.col("f")[rhs]) / F.nullif(F.col("t")[lhs] - F.col("f")[lhs], F.lit(0))
    x = rows.join(ends.withColumn("slope", slope), key)
    off = F.abs(F.col(rhs) - (F.col("f")[rhs] + F.col("slope") * (F.col(lhs) - F.col("f")[lhs])))
    g = x.groupBy(*key, "slope").agg(F.max(off).alias("worst"))
    return g.select(*key, F.when((F.col("slope") > 0) & (F.col("worst") <= most), F.col("slope")).alias("slope"), "worst")


def segment_stats(pairs: DataFrame, key: list[str], lhs: str, rhs: str, step: float) -> DataFrame:
    """Ratio statistics of the segments between pairs; the error is two steps over the shortest segment."""
    s = steps(pairs, key, lhs, rhs).where("dr > 0")
    r = F.col("dl") / F.col("dr")
    err = 2 * step / F.nullif(F.least(F.min("dl"), F.min("dr")), F.lit(0))
    return s.groupBy(*key).agg(F.count("*").alias("n"), F.avg(r).alias("mean"), F.median(r).alias("median"), F.min(r).alias("low"), F.max(r).alias("high"), F.coalesce(err > 0.1, F.lit(True)).alias("low_accuracy"))


# Walks in which each step depends on the ones before: one group a call, Arrow batches.


def history_ok(left: Column, right: Column, cutoff: float, least: int = 3) -> Column:
    """Whether one of the values before on the left is within ``cutoff`` of one on the right.

    With fewer than ``least`` values on both sides there is nothing to ask;
    fewer on one side alone is an error of the input and gives NULL.
    """
    short_l, short_r = F.size(left) < least, F.size(right) < least
    seen = F.exists(left, lambda x: F.exists(right, lambda y: F.abs(x - y) <= cutoff))
    return F.when(short_l & short_r, True).when(~short_l & ~short_r, seen)


def look_ahead(fps: Column) -> Column:
    """Samples that must be dark for a zone to count: one and a half seconds, three at least."""
    return F.greatest(F.lit(3), (fps * 1.5).cast("int"))


def drop_rogues(l: np.ndarray, r: np.ndarray, floor: float = 2000.0, share: float = 0.02) -> np.ndarray:
    """Mask of the pairs that stay: a point between two flagged gaps of opposite sign that cancel is dropped, until none is left."""
    keep = np.arange(len(l))
    while len(keep) >= 3:
        x, y = l[keep], r[keep]
        dl, dr = np.diff(x), np.diff(y)
        if not (dl > 0).any():
            break
        slope = np.median(dr[dl > 0] / dl[dl > 0])
        miss = np.round(dl * slope - dr)
        limit = np.maximum(floor, share * dl)
        flagged = np.abs(miss) > limit
        hit = [i + 1 for i in range(len(miss) - 1) if flagged[i] and flagged[i + 1] and miss[i] * miss[i + 1] < 0 and abs(miss[i] + miss[i + 1]) <= max(limit[i], limit[i + 1])]
        if not hit:
            break
        keep = np.delete(keep, hit[0])
    mask = np.zeros(len(l), dtype=bool)
    mask[keep] = True
    return mask


def strict_mapping(l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Mask of a strictly rising mapping: of equal right values the later stays, falling ones go."""
    keep: list[int] = []
    for i in range(len(l)):
        if keep and r[i] == r[keep[-1]] and l[i] > l[keep[-1]]:
            keep[-1] = i
        elif not keep or (r[i] > r[keep[-1]] and l[i] > l[keep[-1]]):
            keep.append(i)
    mask = np.zeros(len(l), dtype=bool)
    mask[keep] = True
    return mask


def ransac_inliers(x: np.ndarray, y: np.ndarray, threshold: float, seed: int = 0, rounds: int = 200) -> np.ndarray:
    """Mask of the points near the line that most points are near; fewer than three points all stay."""
    n = len(x)
    best = np.ones(n, dtype=bool)
    if n < 3:
        return best
    rng, most = np.random.default_rng(seed), -1
    for _ in range(rounds):
        i, j = rng.choice(n, 2, replace=False)
        if x[i] == x[j]:
            continue
        k = (y[j] - y[i]) / (x[j] - x[i])
        inside = np.abs(y - (y[i] + k * (x - x[i]))) <= threshold
        if inside.sum() > most:
            most, best = inside.sum(), inside
    return best


def walk_boundary(rich: np.ndarray, match: np.ndarray, start: int, step: int, misses: int, dark: int) -> int:
    """Last place reached from ``start``: strides of ``step`` over matching places, one by one near the edge.

    A run of ``dark`` places that aren't rich is jumped over; after more than ``misses`` failures the walk ends.
    """
    at, here, fails, n = start, start, 0, len(match)
    while True:
        nxt = here + step
        if nxt >= n:
            if step == 1:
                return at
            step, here = 1, at
            continue
        if not rich[nxt : nxt + dark].any():
            jump = nxt
            while jump < n and not rich[jump]:
                jump += 1
            if jump >= n:
                return at
            nxt = jump
        here = nxt
        if match[here]:
            at, fails = here, 0
        else:
            fails += 1
            if fails > misses:
                if step == 1:
                    return at
                step, here, fails = 1, at, 0


def merge_short(lengths: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Segments [first, end) after merging: the first short segment joins its predecessor, the very first its successor, until none is short."""
    parts = [(i, i + 1) for i in range(len(lengths))]
    size = lambda p: lengths[p[0] : p[1]].sum()
    while len(parts) > 1:
        short = next((i for i, p in enumerate(parts) if size(p) < least), None)
        if short is None:
            break
        a = 0 if short == 0 else short - 1
        parts[a : a + 2] = [(parts[a][0], parts[a + 1][1])]
    return parts


def masked(rows: DataFrame, key: list[str], lhs: str, rhs: str, rule) -> DataFrame:
    """Applies a mask rule to every group, ordered by (lhs, rhs); groups hold pairs of one time-line, not the corpus."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([lhs, rhs], kind="stable")
        return pdf[rule(pdf[lhs].to_numpy(float), pdf[rhs].to_numpy(float))]

    return rows.groupBy(*key).applyInPandas(run, rows.schema)



def relation(l: np.ndarray, r: np.ndarray, rate_ratio: float = 1.0, *, sigma: float = 1.0, span: float = 250.0, outliers: float = 0.25, slope_off: float = 0.05, res_median: float = 1.5, res_p95: float = 4.0, scale: float = 0.30) -> tuple[str, float, float]:
    """How frame numbers on two time-lines relate: ('constant' | 'linear' | 'none', slope, intercept).

    Constant: r - l deviates by at most ``sigma``; two pairs also need ``span``
    frames between them.  Else a seeded robust line through at least four
    pairs over ``span`` frames, with few outliers, small residuals, and a
    slope near 1 or near the rate ratio.  A time scale further than
    ``scale`` from 1 is none.
    """
    n = len(l)
    if n < 2:
        return "none", float("nan"), float("nan")
    wide = float(l.max() - l.min())
    off = r - l
    if off.std() <= sigma and (n > 2 or wide >= span):
        return "constant", 1.0, float(np.round(np.median(off)))
    if n < 4 or wide < span:
        return "none", float("nan"), float("nan")
    inside = ransac_inliers(l, r, res_p95)
    if 1 - inside.mean() > outliers:
        return "none", float("nan"), float("nan")
    k, b = np.polyfit(l[inside], r[inside], 1)
    res = np.abs(r[inside] - (k * l[inside] + b))
    near = min(abs(k - 1), abs(k - rate_ratio)) <= slope_off
    if not near or np.median(res) > res_median or np.percentile(res, 95) > res_p95 or abs(k / rate_ratio - 1) > scale:
        return "none", float("nan"), float("nan")
    return "linear", float(k), float(b)


def extrapolate(known_l: np.ndarray, known_r: np.ndarray, pool_l: np.ndarray, pool_r: np.ndarray, dist, cutoff: float, tolerance: float = 0.05) -> list[tuple[float, float]]:
    """Known pairs with those that their median ratio predicts, in order of the left side.

    For a free left place the three right places nearest to the prediction
    are tried; the first that is unused, whose ratio to the nearest known
    pair lies within the tolerance and whose distance is under the cutoff joins.
    """
    pairs = sorted(zip(known_l.tolist(), known_r.tolist(), strict=True))
    if len(pairs) < 2:
        return pairs
    dl, dr = np.diff([a for a, _ in pairs]), np.diff([b for _, b in pairs])
    ok = dr != 0
    if not ok.any():
        return pairs
    ratio = float(np.median(dl[ok] / dr[ok]))
    used = {b for _, b in pairs}
    taken = {a for a, _ in pairs}
    base = list(pairs)
    for a in sorted(set(pool_l.tolist()) - taken):
        x, y = min(base, key=lambda p: (abs(p[0] - a), p[0]))
        want = y + (a - x) / ratio
        for b in sorted(pool_r.tolist(), key=lambda v: (abs(v - want), v))[:3]:
            if b in used or b == y:
                continue
            if abs((a - x) / (b - y) - ratio) < tolerance * ratio and dist(a, b) < cutoff:
                pairs.append((a, b))
                used.add(b)
                break
    return sorted(pairs)
