"""Queries of validation and preference rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid.operators import intervals as iv
from reelgrid.operators import matching as mt
from reelgrid.operators import validation as va
from reelgrid.session import load


def subtitle_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of files named after parts: each part has one of six extensions, names repeat."""
    ext = F.element_at(F.array(*map(F.lit, ("srt", "sub", "idx", "mkv", "txt", "SUB"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    parts = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/m/"), "p_brand", F.lit("/"), "p_name", F.lit("."), ext).alias("path"), F.when(F.col("p_size") % 2 == 0, "microdvd").alias("format"))
    return va.subtitle_kind(parts, "path", "format").select("p_partkey", "kind")


def supported_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(F.get(F.array(*map(F.lit, ("video", "audio", "subtitle", "attachment", "attachment", "video"))), F.col("l_linenumber").cast("int") - 1), F.lit("button"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", kind.alias("kind"), F.when(F.col("l_returnflag") == "A", "font/ttf").otherwise("image/png").alias("detail"))
    return va.supported(lines, "l_orderkey", "kind", "detail")


def output_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("key"))
    return va.aliases(out, load(spark, sf_dir, "lineitem").where("l_discount > 0.09").select(F.col("l_orderkey").alias("key")), "key")


def primary_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part")
    return va.primary(parts, ["p_brand", "p_type"], ["p_size", "p_partkey"], F.col("p_retailprice") > 905).select("p_brand", "p_type", "p_partkey")


def same_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part")
    return va.same_series(parts.where("p_partkey % 2 = 0"), parts.where("p_partkey % 2 = 1"), ["p_brand", "p_type"], "p_size", "p_partkey", 30.0)


def preferred_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    wanted = F.when(F.col("source") == "src1", "es").when(F.col("source") == "src2", "xx")
    return va.preferred(docs, ["source"], "lang", wanted, "doc_id").select("source", "doc_id", "lang")


def poor_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.poor_stretch(load(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("value") > 60, 3, 0.4)


def output_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest end over the lines of each order."""
    lines = load(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey").agg(F.max(F.col("l_quantity") + F.coalesce(F.nullif("l_tax", F.lit(0.0)), F.lit(0.0))).alias("end_at"))


def scene_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 5 around the purchases of each user, merged where they touch."""
    ev = load(spark, sf_dir, "events").where("event_type = 'purchase'")
    a, b = iv.window_around(F.col("event_id"), 20)
    return iv.merged(ev.select("user_id", a.alias("a"), b.alias("b")), ["user_id"], "a", "b").select("user_id", "a", "b")


def best_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best match of each vector's place, in its label, among the places of the next label."""
    v = load(spark, sf_dir, "embeddings").select("label", "vec_id", *[h.alias("h") for h in mt.sign_hash(F.col("embedding"))])
    v = v.withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    left = v.select("label", F.col("at").alias("l_at"), F.col("h").alias("lh"))
    right = v.select((F.col("label") - 1).alias("label"), F.col("at").alias("r_at"), F.col("h").alias("rh"))
    guess = left.select("label", "l_at", F.col("l_at").alias("r_at"))
    return va.best_neighbour(left, right, guess, ["label"], "l_at", "r_at", "lh", "rh").select("label", "l_at", "distance", "l", "r")


_ALL = (subtitle_kinds, supported_elements, output_aliases, primary_record, same_series, preferred_record, poor_stretch, output_end, scene_windows, best_neighbour)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "subtitle_kinds": """
        WITH f AS (SELECT p_partkey, p_brand, p_name, lower((['srt', 'sub', 'idx', 'mkv', 'txt', 'SUB'])[CAST(p_partkey % 6 + 1 AS INT)]) AS e, CASE WHEN p_size % 2 = 0 THEN 'microdvd' END AS fmt FROM part),
            g AS (SELECT *, bool_or(e = 'idx') OVER w AS hi, bool_or(e = 'sub') OVER w AS hs FROM f WINDOW w AS (PARTITION BY p_brand, lower(p_name)))
        SELECT p_partkey, CASE WHEN e = 'srt' THEN 'text' WHEN e = 'sub' AND hi THEN 'companion' WHEN e = 'idx' AND hs THEN 'index' WHEN fmt = 'microdvd' THEN 'probed' WHEN e = 'sub' AND fmt IS NULL THEN 'guessed' END AS kind FROM g""",
    "supported_elements": """
        SELECT l_orderkey, CASE WHEN max(l_linenumber) >= 7 THEN 'track' WHEN bool_or(l_linenumber IN (4, 5) AND l_returnflag = 'A') THEN 'attachment'
            WHEN count(*) FILTER (l_linenumber IN (4, 5) AND l_returnflag <> 'A') > 1 THEN 'thumbnails' END AS issue FROM lineitem GROUP BY 1""",
    "output_aliases": "SELECT o_orderkey AS key FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09::DOUBLE)",
    "primary_record": "SELECT p_brand, p_type, p_partkey FROM part WHERE p_retailprice > 905 QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey) = 1",
    "same_series": """
        WITH n AS (SELECT p_brand, p_type, p_partkey % 2 AS m, p_size, row_number() OVER (PARTITION BY p_brand, p_type, p_partkey % 2 ORDER BY p_partkey) AS i FROM part),
            j AS (SELECT p_brand, p_type, i, max(p_size) FILTER (m = 0) AS a, max(p_size) FILTER (m = 1) AS b FROM n GROUP BY ALL)
        SELECT p_brand, p_type, count(*) FILTER (a IS NULL OR b IS NULL) = 0 AND coalesce(max(abs(a - b)) <= 30, true) AS same FROM j GROUP BY ALL""",
    "preferred_record": """
        WITH f AS (SELECT source, doc_id, lang, first_value(lang) OVER (PARTITION BY source ORDER BY doc_id) AS f, CASE source WHEN 'src1' THEN 'es' WHEN 'src2' THEN 'xx' END AS w FROM documents)
        SELECT source, doc_id, lang FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = w THEN 0 WHEN lang = f THEN 1 ELSE 2 END, doc_id) = 1""",
    "poor_stretch": """
        WITH x AS (SELECT user_id, CASE WHEN value > 60 THEN 1 ELSE 0 END AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), f AS (SELECT *, min(CASE WHEN r = 0 THEN i END) OVER (PARTITION BY user_id) AS f FROM x)
        SELECT user_id, coalesce(min(f) - 1 <= 3 AND avg(r) FILTER (i >= f) <= 0.4, false) AS poor FROM f GROUP BY 1""",
    "output_end": "SELECT l_orderkey, max(l_quantity + l_tax) AS end_at FROM lineitem GROUP BY 1",
    "scene_windows": """
        WITH i AS (SELECT user_id, greatest(0, event_id - 20) AS a, event_id + 20 AS b FROM events WHERE event_type = 'purchase'),
            f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM i), g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isle FROM f)
        SELECT user_id, min(a) AS a, max(b) AS b FROM g GROUP BY user_id, isle""",
    "best_neighbour": """
        WITH v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS at, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
            d AS (SELECT g.label, g.at AS l_at, x.at AS l, y.at AS r, CAST(list_sum(list_transform(list_zip(x.b, y.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
                FROM v g, v x, v y WHERE x.label = g.label AND y.label = g.label + 1 AND abs(x.at - g.at) <= 1 AND abs(y.at - g.at) <= 1)
        SELECT label, CAST(l_at AS INTEGER) AS l_at, distance, CAST(l AS INTEGER) AS l, CAST(r AS INTEGER) AS r FROM d QUALIFY row_number() OVER (PARTITION BY label, l_at ORDER BY distance, l, r) = 1""",
}
