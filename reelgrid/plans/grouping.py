"""Queries that group, validate and elect records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.operators import election as el
from reelgrid.operators.grouping import part_groups, part_issue, split_groups, split_plan, with_default
from reelgrid.session import load

PRIORITY = ["fr", "de"]


def part_sequence_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = part_groups(load(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_linenumber"))
    return g.where(part_issue(F.col("parts")) == "ok").select("l_orderkey", F.size("parts").alias("n"))


def part_sequence_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = part_groups(load(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_linenumber"))
    return g.select("l_orderkey", part_issue(F.col("parts")).alias("issue"))


def provider_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.md5("text").alias("key"), "source")
    return el.duplicates(docs, ["key"], "source").select("key", "n", "valid")


def priority_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    lang = F.nullif("lang", F.lit("es"))
    return docs.select("doc_id", el.priority_rank(lang, PRIORITY).alias("rank"))


def best_stream_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part")
    got = el.elected(parts, ["p_brand"], "p_type", [F.col("p_size"), F.col("p_retailprice")], F.col("p_partkey"))
    return got.select("p_brand", "p_type", "p_partkey", "entries")


def best_stream_all_compete(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part")
    got = el.elected(parts, ["p_brand"], "p_type", [F.col("p_size"), F.col("p_retailprice")], F.col("p_partkey"), F.col("p_partkey").isin(7, 8, 9), True)
    return got.select("p_brand", "p_type", "p_partkey", "entries")


def best_group_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    per = lines.groupBy("l_orderkey").agg(F.count("*").alias("nl"))
    cust = orders.join(per, orders.o_orderkey == per.l_orderkey, "left").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = cust.groupBy("c_nationkey", "c_custkey").agg(F.count("*").alias("orders"), F.coalesce(F.sum("nl"), F.lit(0)).alias("lines"))
    return el.best_of(n, ["c_nationkey"], ["c_custkey", "orders", "lines"], F.col("orders"), F.col("lines"), -F.col("c_custkey"))


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    want = ev.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("expected_n"), F.max("event_id").alias("want_end"))
    have = ev.where("value > 10").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("found_n"), F.max("event_id").alias("have_end"))
    gap = F.col("want_end") - F.col("have_end")
    return el.accepted(want, have, ["user_id"], "n", gap, gap)


def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    j = docs.join(labels, "doc_id", "left")
    return j.groupBy("source").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("quality") == 0).alias("low_quality"),
        F.count_if(F.col("toxic") == 1).alias("toxic"),
        F.count_if(F.col("quality").isNull()).alias("unlabelled"),
    )


def first_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return pages.groupBy(host.alias("host")).agg(F.min_by("url", "page_id").alias("url"), F.min("page_id").alias("page_id"))


def language_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    many = F.count("*").over(Window.partitionBy("source", "lang")) > 1
    return docs.select("doc_id", F.when(many & ~F.col("doc_id").cast("string").startswith("1"), F.concat_ws("-", "source", "doc_id")).otherwise(F.col("lang")).alias("name"))


def length_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    g = lines.groupBy("l_orderkey").agg(
        F.min_by("l_quantity", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("base"),
        F.max("l_quantity").alias("longest"),
        F.count("*").alias("n"),
        F.count_distinct("l_suppkey").alias("supps"),
    )
    return g.select(
        "l_orderkey",
        el.first_issue(("single", F.col("n") < 2), ("length", el.length_mismatch(F.col("base"), F.col("longest"))), ("source", F.col("supps") < F.col("n"))).alias("issue"),
    )


def nearest_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.lit("root"), "source", "lang", "doc_id").alias("path"))
    meta = spark.createDataFrame([("root", "audio_lang", "eng"), ("root/src1", "audio_lang", "pol"), ("root/src1/fr", "audio_lang", "fra"), ("root/src2/de", "use_video", "yes")], "path string, key string, value string")
    return el.nearest_metadata(docs, meta, "path").select("doc_id", "ancestor", "key", "value")


def highest_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    lines = load(spark, sf_dir, "lineitem")
    n = lines.groupBy("l_returnflag", F.floor("l_quantity").cast("int").alias("q")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("l_returnflag")
    share = F.sum("n").over(w.orderBy(F.col("q").desc())) / F.sum("n").over(w)
    return el.highest_passing(n.select("l_returnflag", "q", share.alias("share")), ["l_returnflag"], "q", "share", 0.75)


def mean_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    return lines.groupBy("l_shipdate").agg(F.round(el.mean_quality(F.col("l_discount")), 9).alias("quality"))


def entropy_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    return el.entropy(ev, ["user_id"], "value", 0.0, 512.0).select("user_id", F.round("entropy", 6).alias("entropy"))


def _split_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each line: parts beside each other, parts in a folder, and names without a part."""
    k, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    path = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("/m/film"), k, F.lit(" CD"), n, F.lit(".avi"))).when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit("/m/film"), k, F.lit("/cd"), n, F.lit(".RMVB")))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", F.coalesce(path, F.concat(F.lit("/m/film"), k, F.lit(" acd"), n, F.lit(".mkv"))).alias("path"))


def split_part_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_groups(_split_paths(spark, sf_dir), "path").select("name", F.size("parts").alias("n"), F.element_at("parts", 1)["path"].alias("first"), "issue")


def split_part_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_plan(_split_paths(spark, sf_dir), "path", True).select("name", F.size("parts").alias("n"), F.element_at("parts", -1)["path"].alias("last"))


def default_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first returned line of each order is its default."""
    kind = F.when(F.col("l_returnflag") == "A", "audio").otherwise("other")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"))
    return with_default(lines, ["l_orderkey"], "kind", "l_linenumber")


def rich_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el.rich(load(spark, sf_dir, "events"), ["user_id"], "value", 0.0, 512.0).select("user_id", F.round("entropy", 6).alias("entropy"))


_ALL = (
    split_part_groups, split_part_plan, default_tracks, rich_users, part_sequence_valid, part_sequence_issue, provider_duplicates, priority_sort_rank, best_stream_election, best_stream_all_compete, best_group_candidate,
    stream_counts, plan_totals, first_attachment, language_groups, length_validation, nearest_metadata, highest_passing, mean_quality, entropy_by_user,
)
QUERIES = {f.__name__: f for f in _ALL}

_ELECT = """
    WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL),
        m AS (SELECT *, max(n) OVER (PARTITION BY p_brand) AS most FROM c),
        r AS (SELECT part.*, m.n, row_number() OVER (PARTITION BY p_brand ORDER BY {forced} {lead} p_size DESC NULLS LAST, p_retailprice DESC NULLS LAST, p_partkey) AS rk
            FROM part JOIN m USING (p_brand, p_type))
    SELECT p_brand, p_type, r.p_partkey, CAST(r.n AS BIGINT) AS entries FROM r JOIN (SELECT p_brand, p_type AS won, {is_forced} AS f FROM r WHERE rk = 1) x USING (p_brand)
    WHERE CASE WHEN f THEN {is_forced} ELSE p_type = won END"""
_PARTS = """p AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE l_orderkey % 3 WHEN 0 THEN '/m/film' || l_orderkey || '.avi' ELSE '/m/film' || l_orderkey || '/film' || l_orderkey || '.mkv' END AS name,
            CASE l_orderkey % 3 WHEN 0 THEN '/m/film' || l_orderkey || ' CD' || l_linenumber || '.avi' ELSE '/m/film' || l_orderkey || '/cd' || l_linenumber || '.RMVB' END AS path FROM lineitem WHERE l_orderkey % 3 < 2),
        g AS (SELECT name, CAST(count(*) AS INTEGER) AS n, first(path ORDER BY n, path) AS first, last(path ORDER BY n, path) AS last, CASE WHEN count(*) < 2 THEN 'single'
            WHEN min(n) = 1 AND max(n) = count(*) AND count(DISTINCT n) = count(*) THEN 'ok' ELSE 'gap' END AS issue FROM p GROUP BY 1)"""
ORACLES = {
    "split_part_groups": f"WITH {_PARTS} SELECT name, n, first, issue FROM g",
    "split_part_plan": f"WITH {_PARTS} SELECT name, n, last FROM g WHERE issue = 'ok'",
    "default_tracks": """
        WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'audio' ELSE 'other' END AS kind FROM lineitem)
        SELECT *, kind = 'audio' AND l_linenumber = min(CASE WHEN kind = 'audio' THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS "default" FROM a""",
    "rich_users": """
        WITH b AS (SELECT user_id, greatest(0, least(255, CAST(floor(value / 2.0) AS INT))) AS b, count(*) AS n FROM events GROUP BY ALL),
            p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM b)
        SELECT user_id, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY 1 HAVING -sum(p * ln(p)) > 3.5""",
    "part_sequence_valid": """
        SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY l_orderkey
        HAVING count(*) >= 2 AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*)
           AND count(DISTINCT l_linenumber) = count(*)""",
    "part_sequence_issue": """
        SELECT l_orderkey, CASE WHEN count(*) < 2 THEN 'single' WHEN min(l_linenumber) = 1 AND max(l_linenumber) = count(*)
            AND count(DISTINCT l_linenumber) = count(*) THEN 'ok' ELSE 'gap' END AS issue FROM lineitem GROUP BY l_orderkey""",
    "provider_duplicates": "SELECT md5(text) AS key, count(*) AS n, count(*) = count(DISTINCT source) AS valid FROM documents GROUP BY 1 HAVING count(*) > 1",
    "priority_sort_rank": "SELECT doc_id, CASE lang WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 ELSE 4 END AS rank FROM documents",
    "best_stream_election": _ELECT.format(forced="", is_forced="false", lead="CASE WHEN n = most THEN 0 ELSE 1 END,"),
    "best_stream_all_compete": _ELECT.format(forced="CASE WHEN p_partkey IN (7, 8, 9) THEN 0 ELSE 1 END,", is_forced="p_partkey IN (7, 8, 9)", lead=""),
    "best_group_candidate": """
        WITH n AS (SELECT c_nationkey, c_custkey, count(*) AS orders, CAST(coalesce(sum(nl), 0) AS BIGINT) AS lines FROM orders
            JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS nl FROM lineitem GROUP BY 1) x ON o_orderkey = l_orderkey GROUP BY ALL)
        SELECT c_nationkey, c_custkey, orders, lines FROM n QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY orders DESC, lines DESC, c_custkey) = 1""",
    "stream_counts": """
        WITH w AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n, max(event_id) AS e FROM events GROUP BY 1),
            h AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n, max(event_id) AS e FROM events WHERE value > 10 GROUP BY 1)
        SELECT w.user_id, w.n = coalesce(h.n, 0) AND coalesce(w.e - h.e <= 1000, true) AND coalesce(w.e - h.e <= 250, true) AS accepted FROM w LEFT JOIN h USING (user_id)""",
    "plan_totals": """
        SELECT source, count(*) AS files, count(*) FILTER (quality = 0) AS low_quality, count(*) FILTER (toxic = 1) AS toxic,
            count(*) FILTER (quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
    "first_attachment": "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, arg_min(url, page_id) AS url, min(page_id) AS page_id FROM pages GROUP BY 1",
    "language_groups": """
        SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY source, lang) > 1 AND NOT starts_with(CAST(doc_id AS VARCHAR), '1')
            THEN source || '-' || doc_id ELSE lang END AS name FROM documents""",
    "length_validation": """
        WITH f AS (SELECT *, first_value(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS base FROM lineitem)
        SELECT l_orderkey, CASE WHEN count(*) < 2 THEN 'single' WHEN min(base) <> max(l_quantity) THEN 'length'
            WHEN count(DISTINCT l_suppkey) < count(*) THEN 'source' END AS issue FROM f GROUP BY l_orderkey""",
    "nearest_metadata": """
        SELECT doc_id, CASE WHEN source = 'src1' AND lang = 'fr' THEN 'root/src1/fr' WHEN source = 'src1' THEN 'root/src1' WHEN source = 'src2' AND lang = 'de' THEN 'root/src2/de' ELSE 'root' END AS ancestor,
            CASE WHEN source = 'src2' AND lang = 'de' THEN 'use_video' ELSE 'audio_lang' END AS key,
            CASE WHEN source = 'src1' AND lang = 'fr' THEN 'fra' WHEN source = 'src1' THEN 'pol' WHEN source = 'src2' AND lang = 'de' THEN 'yes' ELSE 'eng' END AS value FROM documents""",
    "highest_passing": """
        WITH n AS (SELECT l_returnflag, CAST(floor(l_quantity) AS INTEGER) AS q, count(*) AS n FROM lineitem GROUP BY ALL),
            s AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY q DESC) / sum(n) OVER (PARTITION BY l_returnflag) AS share FROM n)
        SELECT l_returnflag, max(q) FILTER (share >= 0.75) AS best FROM s GROUP BY 1""",
    "mean_quality": "SELECT l_shipdate, round(coalesce(avg(nullif(l_discount, 0)), 0), 9) AS quality FROM lineitem GROUP BY 1",
    "entropy_by_user": """
        WITH b AS (SELECT user_id, greatest(0, least(255, CAST(floor(value / 2.0) AS INT))) AS b, count(*) AS n FROM events GROUP BY ALL),
            p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM b)
        SELECT user_id, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY 1""",
}
