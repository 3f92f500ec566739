"""Grouping and validation of numbered parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions import scalars as sc


def part_groups(df: DataFrame, keys: list[str], part: Column) -> DataFrame:
    """One row a group with its sorted part numbers."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(part.cast("int"))).alias("parts"))


def part_issue(parts: Column) -> Column:
    """'ok' when the parts are exactly 1..N with N >= 2, 'single' for one part, else 'gap'."""
    n = F.size(parts)
    return F.when(n < 2, "single").when(parts == F.sequence(F.lit(1), n), "ok").otherwise("gap")


def split_groups(files: DataFrame, path: str) -> DataFrame:
    """Files that are parts of one whole: its name, the parts in order as (part, path), and the issue of ``part_issue``."""
    parts = files.select(F.col(path).alias("path"), sc.split_part(F.col(path)).alias("_s")).where("_s is not null")
    g = parts.groupBy(F.col("_s.name").alias("name")).agg(F.array_sort(F.collect_list(F.struct(F.col("_s.part").alias("part"), "path"))).alias("parts"))
    return g.withColumn("issue", part_issue(F.col("parts.part")))


def split_plan(files: DataFrame, path: str, ignore_warnings: bool = False) -> DataFrame:
    """What to join: all groups if none has an issue, else nothing; with ``ignore_warnings`` the groups without one."""
    g = split_groups(files, path)
    if not ignore_warnings:
        g = g.crossJoin(F.broadcast(g.agg(F.coalesce(F.max(F.col("issue") != "ok"), F.lit(False)).alias("_bad")))).where("not _bad").drop("_bad")
    return g.where("issue = 'ok'").drop("issue")


def with_default(tracks: DataFrame, key: list[str], kind: str, order: str) -> DataFrame:
    """Marks the first audio track of each key as its default."""
    first = tracks.where(F.col(kind) == "audio").groupBy(*key).agg(F.min(order).alias("_first"))
    return tracks.join(first, key, "left").withColumn("default", F.coalesce((F.col(kind) == "audio") & (F.col(order) == F.col("_first")), F.lit(False))).drop("_first")
