"""Decision tables, tolerances, clock transforms and segment targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strategy(relation: Column, ratio: Column, drift: float = 0.005, most: float = 0.3) -> Column:
    """How to bring one clock to another: no scaling, one scale, or piece by piece."""
    off = F.abs(ratio - 1)
    return F.when((relation == "constant") & (off < drift), "unscaled").when(relation == "irregular", "subsegment").when((relation == "constant") | (off <= most), "global_time_scale").otherwise("subsegment")


def duration_tolerance_ms(rate: Column, segments: Column, encoded: Column, tail: Column | None = None) -> Column:
    """One sample a segment, one frame of 1024 samples when encoded, the filter's tail, and 2 ms."""
    samples = segments + F.when(encoded, 1024).otherwise(0) + (F.lit(0) if tail is None else tail)
    return (F.ceil(F.lit(1000.0) * samples / rate) + 2).cast("bigint")


def video_to_stream(at: Column, video_start: Column) -> Column:
    return at + video_start


def video_to_audio(at: Column, video_start: Column, audio_start: Column) -> Column:
    return at + video_start - audio_start


def audio_to_video(at: Column, video_start: Column, audio_start: Column) -> Column:
    return at - video_start + audio_start


def scene_of(rows: DataFrame, key: list[str], at: str, boundary: Column) -> DataFrame:
    """Number of boundaries up to each row."""
    w = Window.partitionBy(*key).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("scene", F.sum(F.when(boundary, 1).otherwise(0)).over(w))


def best_fraction(x: Column, most: int) -> Column:
    """The fraction with a denominator up to ``most`` nearest to x, the smallest denominator on a tie."""
    parts = F.transform(F.sequence(F.lit(1).cast("bigint"), F.lit(most).cast("bigint")), lambda d: F.struct(F.round(F.abs(F.bround(x * d) / d - x), 12).alias("error"), d.alias("den"), F.bround(x * d).cast("bigint").alias("num")))
    return F.array_min(parts)


def nearest_to_targets(rows: DataFrame, key: list[str], at: str, parts: int) -> DataFrame:
    """For each of ``parts`` + 1 even targets between a key's ends, the nearest row, the earlier on a tie."""
    ends = rows.groupBy(*key).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    targets = ends.select(*key, "_a", "_b", F.explode(F.sequence(F.lit(0), F.lit(parts))).alias("i"))
    off = F.abs(F.col(at) - (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("i") / parts))
    best = F.min_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(off, F.col(at)))
    return targets.join(rows, key).groupBy(*key, "i").agg(best.alias("_r")).select(*key, "i", "_r.*")
