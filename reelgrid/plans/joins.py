"""Queries that join: prefix, positional, two-stage, distance, nearest key, overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions import scalars as sc
from reelgrid.operators import matching as mt
from reelgrid.session import load


def prefix_match_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with the longest of: their first words, and the full names of small parts."""
    parts = load(spark, sf_dir, "part")
    one = parts.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("prefix"), F.lit("k").alias("dir"))
    two = parts.where("p_size < 10").select(F.col("p_name").alias("prefix"), F.lit("k").alias("dir"))
    prefixes = one.union(two).groupBy("dir", "prefix").agg(F.count("*").alias("ord")).where("ord > 1")
    got = mt.prefix_longest(parts.select("p_partkey", "p_name", F.lit("k").alias("dir")), prefixes, "p_name", "prefix", ["dir"], "ord")
    return got.select("p_partkey", "prefix", "ord")


def prefix_leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_brand").alias("dir"))
    prefixes = load(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_brand").alias("dir"), F.substring("p_name", 1, 6).alias("prefix")).groupBy("dir", "prefix").agg(F.count("*").alias("ord"))
    return mt.prefix_longest(parts, prefixes, "p_name", "prefix", ["dir"], "ord").where("prefix is null").select("p_partkey")


def lone_record_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of nations with one supplier take all customers there; nations with equal names for several are left out."""
    from pyspark.sql import Window

    sup = load(spark, sf_dir, "supplier").withColumn("n", F.count("*").over(Window.partitionBy("s_nationkey"))).where("n = 1")
    return sup.join(load(spark, sf_dir, "customer"), F.col("s_nationkey") == F.col("c_nationkey")).select("s_suppkey", "c_custkey")


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of two segments by their place within the nation; places that one side alone has keep a NULL."""
    cust = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "c_mktsegment", "o_orderkey", "o_orderdate")
    a = cust.where("c_mktsegment = 'BUILDING'").select("c_nationkey", F.col("o_orderkey").alias("a_key"), F.col("o_orderdate").alias("a_date"))
    b = cust.where("c_mktsegment = 'MACHINERY'").select("c_nationkey", F.col("o_orderkey").alias("b_key"), F.col("o_orderdate").alias("b_date"))
    return mt.zipped(a, b, ["c_nationkey"], ["a_date", "a_key"], ["b_date", "b_key"]).select("c_nationkey", "pos", "a_key", "b_key")


def two_stage_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with customers, by nation where it is unique on both sides, then in order; who is left over is unmatched."""
    sup = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    cust = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    return mt.two_stage(sup, cust, "k", "s_suppkey", "c_custkey")


def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


def used_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = load(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return load(spark, sf_dir, "part").join(big, "p_partkey", "left_semi").select("p_partkey", "p_brand")


def overrun_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    late = F.datediff("l_shipdate", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).where(late > 2000).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max(late).alias("days"))


def resolver_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each order by its last shipped line: none, tail, rescale or drop."""
    lines, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    last = lines.groupBy("l_orderkey").agg(F.max(F.struct("l_shipdate", "l_quantity")).alias("x"))
    j = orders.join(last, orders.o_orderkey == last.l_orderkey, "left")
    day = F.datediff("x.l_shipdate", "o_orderdate")
    case = F.when(F.col("x").isNull(), "none").when(F.abs(day) <= 30, "tail").when((day > 30) & (day * 23.976 / 25 < 1000), "rescale").otherwise("drop")
    return j.select("o_orderkey", case.alias("resolver"))


def metadata_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of documents: the page's if there is one page for it, else the own, with 'en' taken as unknown."""
    n = F.regexp_extract("url", "/([a-z][a-z])/([0-9]+)", 2).try_cast("bigint")
    pages = load(spark, sf_dir, "pages").select(n.alias("doc_id"), F.regexp_extract("url", "/([a-z][a-z])/", 1).alias("page_lang"))
    over = pages.where("doc_id is not null").groupBy("doc_id").agg(F.min("page_lang").alias("override"))
    return load(spark, sf_dir, "documents").join(over, "doc_id", "left").select("doc_id", F.coalesce("override", F.nullif("lang", F.lit("en"))).alias("lang"))


def hash_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest other vector of each vector by sign hash."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", *[h.alias("h") for h in mt.sign_hash(F.col("embedding"))])
    return mt.nearest_other(v, "vec_id", "h")


def hash_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors whose sign hashes differ in at most 16 bits."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", *[h.alias("h") for h in mt.sign_hash(F.col("embedding"))])
    b = v.select(F.col("vec_id").alias("other"), F.col("h").alias("g"))
    return mt.distance_pairs(v, b, "vec_id", "other", "h", "g", 16).where("vec_id < other")


def greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one assignment of the vectors of label 0 to those of label 1, in order of (distance of sign hashes, vec_id, other)."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", "label", *[h.alias("h") for h in mt.sign_hash(F.col("embedding"))])
    a = v.where("label = 0").select("vec_id", "h")
    b = v.where("label = 1").select(F.col("vec_id").alias("other"), F.col("h").alias("g"))
    return mt.greedy_hashes(a, b, "vec_id", "other", "h", "g")


def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    buys = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = ev.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    got = mt.latest_before(buys, views, ["user_id"], "ts", "view_ts", "view_id")
    return got.where("prev_view_id is not null").select("event_id", "user_id", F.col("prev_view_id").alias("view_id"))


def nearest_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    got = mt.nearest_key(ev.where("event_type = 'click'").select("user_id", "event_id"), ev.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id")), ["user_id"], "event_id", "view_id")
    return got.select("event_id", "nearest")


def predicted_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the view of like value among the three nearest to where the user's first click and view, at equal pace, put it."""
    ev = load(spark, sf_dir, "events")
    clicks, views = (ev.where(F.col("event_type") == t) for t in ("click", "view"))
    first = clicks.groupBy("user_id").agg(F.min("event_id").alias("c0")).join(views.groupBy("user_id").agg(F.min("event_id").alias("v0")), "user_id")
    rows = clicks.join(first, "user_id").select("user_id", "event_id", F.col("value").alias("lv"), (F.col("v0") + F.col("event_id") - F.col("c0")).alias("at"))
    keys = views.select("user_id", F.col("event_id").alias("view_id"), F.col("value").alias("rv"))
    got = mt.predicted_match(rows, keys, ["user_id"], "event_id", "at", "view_id", F.round(F.abs(F.col("lv") - F.col("rv")), 6), 20.0)
    return got.select("event_id", "view_id", "distance")


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    return ev.select("user_id", "event_type").distinct().exceptAll(ev.where("value > 200").select("user_id", "event_type").distinct())


def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"), F.lit(None).cast("string").alias("name"))
    b = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"))
    return a.unionByName(b).distinct()


def bijection_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are on one side alone."""
    a = load(spark, sf_dir, "documents").select("doc_id")
    b = load(spark, sf_dir, "labels").select("doc_id")
    return a.join(b, "doc_id", "left_anti").withColumn("side", F.lit("documents")).union(b.join(a, "doc_id", "left_anti").withColumn("side", F.lit("labels")))


def language_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    over = F.when(F.col("source") == "src3", "ger").when(F.col("source") == "src4", "und")
    return docs.select("doc_id", F.coalesce(sc.unify_language(over), sc.unify_language(F.col("lang"))).alias("lang"), sc.language_name(F.col("lang")).alias("name"))


_ALL = (
    prefix_match_longest, prefix_leftovers, lone_record_join, positional_zip, two_stage_match, unlabelled_documents, used_only, overrun_filter, resolver_case, metadata_coalesce,
    hash_nearest, hash_within, greedy_pairs, asof_nearest, nearest_key, predicted_views, set_difference, set_union, bijection_check, language_overrides,
)
QUERIES = {f.__name__: f for f in _ALL}

_H = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
    d AS (SELECT a.vec_id, c.vec_id AS other, CAST(list_sum(list_transform(list_zip(a.b, c.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
        FROM v a, v c WHERE {where})"""
ORACLES = {
    "prefix_match_longest": """
        WITH x AS (SELECT split_part(p_name, ' ', 1) AS prefix FROM part UNION ALL SELECT p_name FROM part WHERE p_size < 10),
            p AS (SELECT prefix, count(*) AS ord FROM x GROUP BY 1 HAVING count(*) > 1)
        SELECT p_partkey, prefix, ord FROM part LEFT JOIN p ON starts_with(p_name, prefix) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC, ord) = 1""",
    "prefix_leftovers": """SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size = 1 AND a.p_brand = b.p_brand AND starts_with(a.p_name, left(b.p_name, 6)))""",
    "lone_record_join": """SELECT s_suppkey, c_custkey FROM (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1 HAVING count(*) = 1) JOIN customer ON s_nationkey = c_nationkey""",
    "positional_zip": """
        WITH c AS (SELECT c_nationkey, c_mktsegment, o_orderkey, CAST(row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS pos FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT c_nationkey, pos, a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM (SELECT * FROM c WHERE c_mktsegment = 'BUILDING') a FULL JOIN (SELECT * FROM c WHERE c_mktsegment = 'MACHINERY') b USING (c_nationkey, pos)""",
    "two_stage_match": """
        WITH l AS (SELECT s_suppkey, s_nationkey AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier), r AS (SELECT c_custkey, c_nationkey AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
            f AS (SELECT s_suppkey, c_custkey FROM l JOIN r ON l.k = r.k AND l.n = 1 AND r.n = 1),
            a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS pos FROM l WHERE s_suppkey NOT IN (SELECT s_suppkey FROM f)), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS pos FROM r WHERE c_custkey NOT IN (SELECT c_custkey FROM f))
        SELECT s_suppkey, c_custkey, 'key' AS stage FROM f UNION ALL SELECT s_suppkey, c_custkey, CASE WHEN s_suppkey IS NULL OR c_custkey IS NULL THEN 'unmatched' ELSE 'order' END FROM a FULL JOIN b USING (pos)""",
    "unlabelled_documents": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "used_only": "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "overrun_filter": """SELECT l_orderkey, count(*) AS n, CAST(max(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS INTEGER) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 2000 GROUP BY 1""",
    "resolver_case": """
        WITH x AS (SELECT l_orderkey, max(l_shipdate) AS s FROM lineitem GROUP BY 1), d AS (SELECT o_orderkey, s, date_diff('day', CAST(o_orderdate AS DATE), CAST(s AS DATE)) AS day FROM orders LEFT JOIN x ON o_orderkey = l_orderkey)
        SELECT o_orderkey, CASE WHEN s IS NULL THEN 'none' WHEN abs(day) <= 30 THEN 'tail' WHEN day > 30 AND day * 23.976 / 25 < 1000 THEN 'rescale' ELSE 'drop' END AS resolver FROM d""",
    "metadata_coalesce": """
        WITH o AS (SELECT TRY_CAST(regexp_extract(url, '/([a-z][a-z])/([0-9]+)', 2) AS BIGINT) AS doc_id, min(regexp_extract(url, '/([a-z][a-z])/', 1)) AS o FROM pages GROUP BY 1)
        SELECT doc_id, coalesce(o, nullif(lang, 'en')) AS lang FROM documents LEFT JOIN o USING (doc_id)""",
    "hash_nearest": f"WITH {_H.format(where='a.vec_id <> c.vec_id')} SELECT vec_id, distance, other FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, other) = 1",
    "hash_within": f"WITH {_H.format(where='a.vec_id < c.vec_id')} SELECT vec_id, other, distance FROM d WHERE distance <= 16",
    "asof_nearest": """SELECT b.event_id, b.user_id, max(v.event_id) AS view_id FROM events b JOIN events v ON b.user_id = v.user_id AND v.ts < b.ts AND v.event_type = 'view' AND b.event_type = 'purchase'
        WHERE v.ts = (SELECT max(ts) FROM events w WHERE w.user_id = b.user_id AND w.ts < b.ts AND w.event_type = 'view') GROUP BY ALL""",
    "nearest_key": """SELECT c.event_id, (SELECT first(v.event_id ORDER BY abs(v.event_id - c.event_id), v.event_id) FROM events v WHERE v.user_id = c.user_id AND v.event_type = 'view') AS nearest FROM events c WHERE event_type = 'click'""",
    "predicted_views": """
        WITH f AS (SELECT user_id, min(event_id) FILTER (event_type = 'click') AS c0, min(event_id) FILTER (event_type = 'view') AS v0 FROM events GROUP BY 1),
            n AS (SELECT c.event_id, v.event_id AS view_id, round(abs(c.value - v.value), 6) AS distance, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(v.event_id - (v0 + c.event_id - c0)), v.event_id) AS k
                FROM events c JOIN f USING (user_id) JOIN events v ON c.user_id = v.user_id WHERE c.event_type = 'click' AND v.event_type = 'view')
        SELECT event_id, view_id, distance FROM n WHERE k <= 3 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY distance, view_id) = 1 AND distance <= 20""",
    "set_difference": "SELECT DISTINCT user_id, event_type FROM events EXCEPT SELECT user_id, event_type FROM events WHERE value > 200",
    "set_union": "SELECT c_nationkey AS nationkey, NULL::VARCHAR AS name FROM customer UNION SELECT s_nationkey, s_name FROM supplier",
    "bijection_check": "SELECT doc_id, 'documents' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'labels' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "language_overrides": """
        WITH m AS (SELECT doc_id, source, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' END AS l FROM documents)
        SELECT doc_id, CASE WHEN source = 'src3' THEN 'deu' ELSE l END AS lang, CASE l WHEN 'eng' THEN 'English' WHEN 'deu' THEN 'German' WHEN 'fra' THEN 'French' WHEN 'spa' THEN 'Spanish' ELSE 'Unknown' END AS name FROM m""",
}
