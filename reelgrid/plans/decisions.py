"""Queries for decision tables, tolerances, segment plans and conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.operators import decisions as dc
from reelgrid.session import load


def audio_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategy by relation and drift: the sign of a part's size, and its price against its size."""
    parts = load(spark, sf_dir, "part")
    relation = F.when(F.col("p_size") % 3 == 0, "constant").when(F.col("p_size") % 3 == 1, "linear").otherwise("irregular")
    ratio = F.col("p_retailprice") / 1000
    return parts.select("p_partkey", dc.strategy(relation, ratio).alias("strategy"))


def duration_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part")
    rate = F.when(F.col("p_size") % 2 == 0, 48000).otherwise(44100)
    tol = dc.duration_tolerance_ms(rate, F.col("p_size"), F.col("p_size") > 25)
    return parts.select("p_partkey", tol.alias("tolerance"), (F.col("p_retailprice") % 100 <= tol).alias("fits"))


def clock_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    video, audio = F.col("user_id") * 10, F.col("user_id") * 7
    return ev.select("event_id", dc.video_to_stream(F.col("event_id"), video).alias("stream"), dc.video_to_audio(F.col("event_id"), video, audio).alias("audio"), dc.audio_to_video(F.col("event_id"), video, audio).alias("back"))


def scene_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene number of every event: how many of the user's purchases came up to it."""
    ev = load(spark, sf_dir, "events")
    return dc.scene_of(ev, ["user_id"], "event_id", F.col("event_type") == "purchase").select("event_id", "scene")


def rational_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best small fraction for each part's price ratio."""
    parts = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("x"))
    got = parts.select("p_partkey", "x", dc.best_fraction(F.col("x"), 64).alias("f"))
    return got.select("p_partkey", F.col("f.num").alias("num"), F.col("f.den").alias("den"), F.round(F.abs(F.col("f.num") / F.col("f.den") - F.col("x")), 9).alias("error"))


def segment_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of five targets over a user's ids, the event nearest by id."""
    ev = load(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return dc.nearest_to_targets(ev, ["user_id"], "event_id", 4).select("user_id", "i", "event_id")


def broken_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a line longer than the order allows by more than a thousandth; orders without a limit don't count."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("length"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.floor(F.col("o_totalprice") / 10), F.lit(0)).alias("limit"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).where(F.col("length") > F.col("limit") * 1.001).select("o_orderkey")


def event_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' times rescaled by a rate ratio, the last of each user cut to at most 5000 after its start."""
    from pyspark.sql import Window

    ev = load(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") * 100).alias("a"), (F.col("event_id") * 100 + 9000).alias("b"))
    last = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).isNull()
    end = F.when(last, F.least(F.col("a") + 5000, F.col("b"))).otherwise(F.col("b"))
    k = F.lit(24.0) / 25
    return ev.select("event_id", F.bround(F.col("a") * k).cast("bigint").alias("start_ms"), F.bround(end * k).cast("bigint").alias("end_ms"))


_ALL = (audio_strategy, duration_tolerance, clock_transforms, scene_folders, rational_scale, segment_targets, broken_records, event_rescale)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "audio_strategy": """WITH p AS (SELECT p_partkey, p_size % 3 AS m, p_retailprice / 1000 AS r FROM part)
        SELECT p_partkey, CASE WHEN m = 0 AND abs(r - 1) < 0.005 THEN 'unscaled' WHEN m = 2 THEN 'subsegment' WHEN m = 0 OR abs(r - 1) <= 0.3 THEN 'global_time_scale' ELSE 'subsegment' END AS strategy FROM p""",
    "duration_tolerance": """WITH t AS (SELECT p_partkey, p_retailprice, CAST(ceil(1000.0::DOUBLE * (p_size + CASE WHEN p_size > 25 THEN 1024 ELSE 0 END) / CASE WHEN p_size % 2 = 0 THEN 48000 ELSE 44100 END) + 2 AS BIGINT) AS tolerance FROM part)
        SELECT p_partkey, tolerance, p_retailprice % 100 <= tolerance AS fits FROM t""",
    "clock_transforms": "SELECT event_id, event_id + user_id * 10 AS stream, event_id + user_id * 10 - user_id * 7 AS audio, event_id - user_id * 10 + user_id * 7 AS back FROM events",
    "scene_folders": "SELECT event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS scene FROM events",
    "rational_scale": """WITH x AS (SELECT p_partkey, p_retailprice / 1000 AS x, unnest(range(1, 65)) AS den FROM part), f AS (SELECT *, CAST(round_even(x * den, 0) AS BIGINT) AS num FROM x)
        SELECT p_partkey, num, den, round(abs(num / den - x), 9) AS error FROM f QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY round(abs(num / den - x), 12), den) = 1""",
    "segment_targets": """WITH g AS (SELECT user_id, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY 1), t AS (SELECT *, unnest(range(0, 5)) AS i FROM g)
        SELECT t.user_id, CAST(i AS INTEGER) AS i, e.event_id FROM t JOIN events e USING (user_id) QUALIFY row_number() OVER (PARTITION BY t.user_id, i ORDER BY abs(e.event_id - (a + (b - a) * i / 4)), e.event_id) = 1""",
    "broken_records": """SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey, max(l_extendedprice) AS length FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey
        WHERE length > nullif(floor(o_totalprice / 10), 0) * 1.001::DOUBLE""",
    "event_rescale": """WITH e AS (SELECT event_id, event_id * 100 AS a, CASE WHEN lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL THEN least(event_id * 100 + 5000, event_id * 100 + 9000) ELSE event_id * 100 + 9000 END AS b FROM events)
        SELECT event_id, CAST(round_even(a * (24.0::DOUBLE / 25), 0) AS BIGINT) AS start_ms, CAST(round_even(b * (24.0::DOUBLE / 25), 0) AS BIGINT) AS end_ms FROM e""",
}
