"""Queries over single records: paths, times, JSON, languages, timed text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions import scalars as sc
from reelgrid.session import load
from reelgrid.sources import files


def url_scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "")
    pages = load(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    p = F.col("path")
    return pages.select("page_id", sc.path_dir(p).alias("dir"), sc.path_stem(p).alias("stem"), sc.path_ext(p).alias("ext")).where(F.col("ext").isin("html", ""))


def time_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = (F.unix_millis(F.col("ts").cast("timestamp")) % 360_000_000).alias("ms")
    ev = load(spark, sf_dir, "events").select("event_id", ms).withColumn("text", sc.ms_to_time(F.col("ms")))
    return ev.select("event_id", "text", sc.time_to_ms(F.col("text")).alias("back"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("n"), F.max(k).alias("most"))


def subtitle_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle texts made of each user's events, parsed back."""
    from pyspark.sql import Window

    ev = load(spark, sf_dir, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    line = F.concat(F.col("i").cast("string"), F.lit("\n"), sc.ms_to_time(F.col("event_id") * 1000), F.lit(" --> "), sc.ms_to_time(F.col("event_id") * 1000 + 500), F.lit("\n"), F.col("event_type"))
    text = ev.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
    return text.select("user_id", F.explode(files.srt_events(F.col("text"))).alias("e")).select("user_id", "e.*")


def timed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.split_part(sc.ms_to_time(F.col("event_id") * 1000), F.lit(","), F.lit(1))
    line = F.struct("event_id", F.concat(clock, F.lit(":"), F.col("event_type")).alias("t"))
    text = load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("text"))
    return text.select("user_id", F.explode(files.timed_lines(F.col("text"))).alias("e")).select("user_id", "e.*")


def language_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language named in a label that each part gets by its number."""
    labels = ("dubbing en", "PL dub", "Polish lektor", "English", "en", "ger", "audio fr 5.1", "pldub", "Stereo", "Commentary")
    label = F.element_at(F.array(*map(F.lit, labels)), (F.col("p_partkey") % 10 + 1).cast("int"))
    rows = load(spark, sf_dir, "part").select("p_partkey", label.alias("label"))
    return rows.select("p_partkey", F.coalesce(sc.keyword_language(F.col("label")), sc.token_language(F.col("label"))).alias("lang"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes written as rates and read back."""
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_size") * 1000, F.lit("/1001"))).when(F.col("p_size") % 3 == 1, F.col("p_size").cast("string")).otherwise("0/0")
    return load(spark, sf_dir, "part").select("p_partkey", F.round(sc.rate(text), 6).alias("fps"))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", sc.cache_key(F.col("url"), F.length("html"), F.col("page_id")).alias("key"))


def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    return pages.select("page_id", sc.relative_path(sc.replace_prefix(F.col("url"), "https://", "/web/"), F.lit("/web")).alias("path"))


def compact_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", sc.compact_time(F.col("event_id") + 0.5).alias("text"))


def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels")
    return files.upsert(labels, labels.where("toxic = 1").withColumn("quality", F.lit(0)), ["doc_id"])


def clock_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts, ends and offsets of lines as if quantity and tax were seconds."""
    start = sc.seconds_to_ms(F.col("l_quantity").cast("string"))
    path = F.concat(F.lit("/m/a."), F.when(F.col("l_linenumber") % 2 == 0, "mkv").otherwise("avi"))
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", start.alias("start_ms"), sc.corrected_ms(F.col("l_quantity"), F.col("l_linenumber") * 3000 - 15000).alias("corrected"),
        sc.end_offset(start - 20000, F.when(F.col("l_linenumber") != 3, start), F.lit(7).cast("bigint")).alias("end_ms"),
        sc.sync_offset(F.lit(30000).cast("bigint"), sc.kept_start(path, start)).alias("shift"),
    )


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags written as text, and rates within a twentieth of 25."""
    text = F.element_at(F.array(*map(F.lit, ("1", " True", "YES", "on", "0", "off", ""))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", sc.truthy(text).alias("flag"), sc.within_ratio(F.col("p_size"), F.lit(25)).alias("near"))


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names written as a list of quoted strings and read back."""
    text = F.concat(F.lit("["), F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit('"'), w, F.lit(' \\"x\\""'))), ", "), F.lit("]"))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(sc.quoted_list(text), "|").alias("items"))


def report_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score after the last mark of a report of two lines."""
    text = F.concat(F.lit("SSIM All:0.1 (x)\nSSIM Y:0.5 All: "), F.col("p_size").cast("string"), F.lit(".25 (y)"))
    return load(spark, sf_dir, "part").select("p_partkey", sc.last_score(text).alias("score"))


def flac_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt = F.element_at(F.array(*map(F.lit, ("u8", "s16p", "s32", "fltp", "s16"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", sc.flac_format(fmt).alias("fmt"))


def track_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of a track by its name, else by the file's."""
    name = F.when(F.col("p_partkey") % 3 == 0, "Finnish").when(F.col("p_partkey") % 3 == 1, "Main")
    path = F.when(F.col("p_partkey") % 2 == 0, "/m/film dubbing sk.mkv").otherwise("/m/film.mkv")
    return load(spark, sf_dir, "part").select("p_partkey", sc.label_language(name, path).alias("lang"))


def frame_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a log with one line an event; pairs of events share a time."""
    line = F.concat(F.lit("[showinfo] n: "), F.col("event_id").cast("string"), F.lit(" pts: 1 pts_time:"), F.floor(F.col("event_id") / 2).cast("string"), F.lit(".5 x"))
    return files.frame_times(load(spark, sf_dir, "events").select("event_id", line.alias("line")), "line", "event_id")


def probe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of a probe document for each part."""
    size = F.col("p_size").cast("string")
    doc = F.concat(
        F.lit('{"streams": [{"index": 0, "codec_type": "video", "codec_name": "h264", "r_frame_rate": "25/1", "width": '), size,
        F.lit(', "height": 2, "duration": "'), size, F.lit('.5"}, {"index": 1, "codec_type": "audio", "codec_name": "aac", "channels": 2, "tags": {"language": "ger", "DURATION": "00:00:07.250"}}]}'),
    )
    got = files.probe_streams(load(spark, sf_dir, "part").select("p_partkey", doc.alias("doc")), "p_partkey", "doc")
    return got.select("p_partkey", "tid", "stype", "codec", "language", "fps", "length_ms", "width", "channels")


def provider_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External ids of parts, without collections."""
    ids = F.create_map(F.lit("Imdb"), F.concat(F.lit("tt"), F.col("p_partkey").cast("string")), F.lit("TmdbCollection"), F.lit("9"), F.col("p_brand"), F.col("p_size").cast("string"))
    return files.provider_ids(load(spark, sf_dir, "part").select("p_partkey", ids.alias("ids")), "p_partkey", "ids")


_ALL = (clock_offsets, flags, list_items, report_scores, flac_formats, track_labels, frame_log, probe_documents, provider_ids, url_scan_filter, time_roundtrip, json_props, subtitle_parse, timed_text, language_keyword, rates, cache_keys, relative_paths, compact_times, cache_upsert)
QUERIES = {f.__name__: f for f in _ALL}
_P = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')"
_T = "lpad(CAST({0} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0')"
ORACLES = {
    "clock_offsets": """WITH x AS (SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity * 1000, 0) AS BIGINT) AS s FROM lineitem)
        SELECT l_orderkey, l_linenumber, s AS start_ms, greatest(0, s + least(0, l_linenumber * 3000 - 15000)) AS corrected, CASE WHEN l_linenumber = 3 THEN 7 ELSE greatest(s - 20000, 0) + s END AS end_ms,
            nullif(30000 - CASE WHEN l_linenumber % 2 = 0 THEN s ELSE 0 END, 0) AS shift FROM x""",
    "flags": "SELECT p_partkey, p_partkey % 7 < 4 AS flag, abs(p_size - 25) < 1.25 AS near FROM part",
    "list_items": """SELECT p_partkey, replace(p_name, ' ', ' "x"|') || ' "x"' AS items FROM part""",
    "report_scores": "SELECT p_partkey, p_size + 0.25::DOUBLE AS score FROM part",
    "flac_formats": "SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1, 4) THEN 's16' ELSE 's32' END AS fmt FROM part",
    "track_labels": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'fin' WHEN p_partkey % 2 = 0 THEN 'slk' END AS lang FROM part",
    "frame_log": "SELECT (event_id // 2) * 1000 + 500 AS ts_ms, max(event_id) AS frame_id FROM events GROUP BY 1",
    "probe_documents": """SELECT p_partkey, 0::INTEGER AS tid, 'video' AS stype, 'h264' AS codec, NULL::VARCHAR AS language, 25.0::DOUBLE AS fps, CAST(p_size * 1000 + 500 AS BIGINT) AS length_ms, CAST(p_size AS INTEGER) AS width, NULL::INTEGER AS channels FROM part
        UNION ALL SELECT p_partkey, 1, 'audio', 'aac', 'deu', NULL, 7250, NULL, 2 FROM part""",
    "provider_ids": "SELECT p_partkey, 'Imdb' AS provider, 'tt' || p_partkey AS id FROM part UNION ALL SELECT p_partkey, p_brand, CAST(p_size AS VARCHAR) FROM part",
    "url_scan_filter": f"""WITH x AS (SELECT page_id, {_P} AS p FROM pages), n AS (SELECT page_id, regexp_extract(p, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(p, '([^/]*)$', 1) AS name FROM x)
        SELECT page_id, dir, regexp_replace(name, '\\.[^.]*$', '') AS stem, lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) AS ext FROM n WHERE lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) IN ('html', '')""",
    "time_roundtrip": f"WITH m AS (SELECT event_id, epoch_us(ts) // 1000 % 360000000 AS ms FROM events) SELECT event_id, {_T.format('ms')} || ',' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS text, ms AS back FROM m",
    "json_props": "SELECT event_type, CAST(sum(CAST(props ->> '$.k' AS INTEGER)) AS BIGINT) AS total, count(props ->> '$.k') AS n, max(CAST(props ->> '$.k' AS INTEGER)) AS most FROM events GROUP BY 1",
    "subtitle_parse": "SELECT user_id, event_id * 1000 AS start_ms, event_id * 1000 + 500 AS end_ms, event_type AS text FROM events",
    "timed_text": "SELECT user_id, event_id * 1000 AS start_ms, event_type AS text FROM events",
    "language_keyword": "SELECT p_partkey, (['eng', 'pol', 'pol', 'eng', NULL, 'deu', 'fra', 'pol', NULL, NULL])[CAST(p_partkey % 10 + 1 AS INT)] AS lang FROM part",
    "rates": "SELECT p_partkey, round(CASE p_size % 3 WHEN 0 THEN p_size * 1000 / 1001.0::DOUBLE WHEN 1 THEN p_size END, 6) AS fps FROM part",
    "cache_keys": "SELECT page_id, left(sha256(url || ':' || length(html) || ':' || page_id), 16) AS key FROM pages",
    "relative_paths": "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS path FROM pages",
    "compact_times": """WITH s AS (SELECT event_id, CAST(round_even(event_id + 0.5, 0) AS BIGINT) AS s FROM events)
        SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS text FROM s""",
    "cache_upsert": "SELECT doc_id, CASE WHEN toxic = 1 THEN 0 ELSE quality END AS quality, toxic FROM labels",
}
