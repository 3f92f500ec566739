"""Event islands on a stream: sessions whose windows touch, closed by a watermark.

An extension: the batch operator ``intervals.merged`` defines the result; late
events beyond the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def island_stream(events: DataFrame, key: str, at: str, half: str, late: str) -> DataFrame:
    """(key, start, end, n) of each session; two events share one when they lie at most two halves apart."""
    gap = f"{2 * int(half.split()[0])} {half.split()[1]}"
    s = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, (F.col("w.start") - F.expr(f"interval {half}")).alias("start_at"), (F.col("w.end") - F.expr(f"interval {half}")).alias("end_at"), "n")
