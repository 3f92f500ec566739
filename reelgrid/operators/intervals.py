"""Interval algebra over (key, start, end) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(rows: DataFrame, key: list[str], start: str, end: str, reach: int | float = 0) -> DataFrame:
    """Islands of intervals; one joins the island before when its start is at most ``reach`` after the end so far."""
    w = Window.partitionBy(*key).orderBy(start, end)
    high = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flag = F.when(high.isNull() | (F.col(start) > high + reach), 1).otherwise(0)
    isle = rows.select("*", flag.alias("_new")).withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return isle.groupBy(*key, "_isle").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_isle")


#: Beyond every whole number that marks a place.
_FAR = 1 << 62


def ranges_around(points: DataFrame, bounds: DataFrame, key: list[str], at: str, margin: int) -> DataFrame:
    """Whole ranges within ``margin`` of the points of a key, cut to its [low, high], joined where they touch.

    A key of ``bounds`` (key, low, high) without points gets its full range.
    """
    near = bounds.join(points.select(*key, F.col(at).alias("_at")), key, "left")
    lo, hi = F.greatest("low", F.col("_at") - margin), F.least("high", F.col("_at") + margin)
    none = F.col("_at").isNull()
    cut = near.select(*key, F.when(none, F.col("low")).otherwise(lo).alias("first"), F.when(none, F.col("high")).otherwise(hi).alias("last"))
    return merged(cut.where("first <= last").distinct(), key, "first", "last", 1).select(*key, "first", "last")


def complement(isles: DataFrame, key: list[str], start: str, end: str, step: int = 1, bounds: DataFrame | None = None) -> DataFrame:
    """Gaps between the islands of a key: from one end plus ``step`` to the next start minus ``step``.

    With ``bounds`` (key, low, high), also what lies before the first and
    after the last island; a key without islands is one gap from low to high.
    """
    rows = isles.select(*key, F.col(start).alias("_a"), F.col(end).alias("_b"))
    if bounds is not None:
        far = F.lit(_FAR)
        rows = rows.union(bounds.select(*key, -far, F.col("low") - step)).union(bounds.select(*key, F.col("high") + step, far))
    so_far = F.max("_b").over(Window.partitionBy(*key).orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1))
    gap = rows.select(*key, (so_far + step).alias("gap_start"), (F.col("_a") - step).alias("gap_end"))
    return gap.where("gap_start is not null and gap_start <= gap_end")


def window_around(at: Column, half: Column | int | float) -> tuple[Column, Column]:
    """[at - half, at + half] with the start not below 0."""
    return F.greatest(F.lit(0), at - half), at + half


def clipped(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """What [a0, a1) and [b0, b1) share, and what of the first is missing before and after."""
    lo, hi = F.greatest(a0, b0), F.least(a1, b1)
    return F.struct(lo.alias("start"), F.greatest(lo, hi).alias("end"), F.greatest(F.lit(0), F.least(b0, a1) - a0).alias("missing_before"), F.greatest(F.lit(0), a1 - F.greatest(b1, a0)).alias("missing_after"))


def even_starts(span: Column, every: int, least: int, most: int) -> Column:
    """Starts of n = clamp(span div every) evenly spaced segments, half to even."""
    n = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(span / every))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bround(i * (span / n)).cast("bigint"))
