"""File listings, timed-text parsing, probe documents and keyed caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.functions import scalars as sc


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Files under a root: path, dir, stem, ext, size and time, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    p = F.col("path")
    return files.select("path", sc.path_dir(p).alias("dir"), sc.path_stem(p).alias("stem"), sc.path_ext(p).alias("ext"), "length", "modificationTime")


def prune_below(files: DataFrame, holders: DataFrame) -> DataFrame:
    """Files that no directory with a holder contains, at any depth above them."""
    parts = F.split("dir", "/")
    up = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i)))).alias("dir"))
    hit = up.join(holders.select("dir").distinct(), "dir", "left_semi").select("path").distinct()
    return files.join(hit, "path", "left_anti")


def srt_events(text: Column) -> Column:
    """Events (start_ms, end_ms, text) of a subtitle text: number, times, lines, blank line."""
    blocks = F.regexp_extract_all(F.concat(F.regexp_replace(text, "\r\n?", "\n"), F.lit("\n\n")), F.lit("(?s)(\\d+:\\d+:\\d+[,.]\\d+ *--> *\\d+:\\d+:\\d+[,.]\\d+[^\n]*\n.*?)\n\\s*\n"), F.lit(1))

    def event(b: Column) -> Column:
        times = F.split(F.split_part(b, F.lit("\n"), F.lit(1)), " *--> *")
        return F.struct(
            sc.time_to_ms(F.trim(times[0])).alias("start_ms"),
            sc.time_to_ms(F.regexp_extract(times[1], "^(\\S+)", 1)).alias("end_ms"),
            F.trim(F.regexp_replace(b, "^[^\n]*\n", "")).alias("text"),
        )

    return F.transform(blocks, event)


def timed_lines(text: Column) -> Column:
    """Events (start_ms, text) of lines HH:MM:SS:text."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: x.rlike("^\\d+:\\d+:\\d+:"))
    return F.transform(lines, lambda x: F.struct(sc.time_to_ms(F.concat(F.regexp_extract(x, "^(\\d+:\\d+:\\d+):", 1), F.lit(".0"))).alias("start_ms"), F.regexp_replace(x, "^\\d+:\\d+:\\d+:", "").alias("text")))


def frame_times(lines: DataFrame, line: str, order: str, correction: int = 0) -> DataFrame:
    """(ts_ms, frame_id) of log lines with n: and pts_time:; of frames with one time the last in order counts."""
    n = F.regexp_extract(line, "\\bn: *(\\d+)", 1).try_cast("bigint")
    at = sc.corrected_ms(F.regexp_extract(line, "pts_time: *(-?[0-9.]+)", 1), F.lit(correction))
    return lines.select(at.alias("ts_ms"), n.alias("frame_id"), order).where("ts_ms is not null and frame_id is not null").groupBy("ts_ms").agg(F.max_by("frame_id", order).alias("frame_id"))


STREAM = T.StructType([T.StructField(n, T.StringType()) for n in ("index", "codec_type", "codec_name", "r_frame_rate", "width", "height", "channels", "sample_rate", "start_time", "duration")] + [T.StructField("tags", T.MapType(T.StringType(), T.StringType()))])
PROBE = T.StructType([T.StructField("streams", T.ArrayType(STREAM))])


def probe_streams(docs: DataFrame, path: str, json: str) -> DataFrame:
    """One row a stream of probe documents, normalised; unreadable documents have none."""
    s = docs.select(path, F.explode(F.from_json(json, PROBE)["streams"]).alias("s"))
    ms = F.coalesce(sc.seconds_to_ms(F.col("s.duration")), sc.time_to_ms(F.try_element_at("s.tags", F.lit("DURATION"))))
    whole = lambda c: F.col(f"s.{c}").try_cast("int").alias(c)
    return s.select(
        path, F.col("s.index").try_cast("int").alias("tid"), F.col("s.codec_type").alias("stype"), F.col("s.codec_name").alias("codec"), sc.unify_language(F.try_element_at("s.tags", F.lit("language"))).alias("language"),
        F.when(F.col("s.codec_type") == "video", sc.rate(F.col("s.r_frame_rate"))).alias("fps"), ms.alias("length_ms"), whole("width"), whole("height"), whole("channels"), whole("sample_rate"),
    )


def provider_ids(items: DataFrame, name: str, ids: str, skip: tuple[str, ...] = ("TmdbCollection",)) -> DataFrame:
    """One row for each external id of an item, without collections."""
    return items.select(name, F.explode(F.map_entries(ids)).alias("e")).select(name, F.col("e.key").alias("provider"), F.col("e.value").alias("id")).where(~F.col("provider").isin(*skip))


def upsert(cache: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The cache with ``rows`` in place of what it had under their keys."""
    return cache.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)
