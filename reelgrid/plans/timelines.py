"""Queries over events as time-lines: gaps, islands, fits, coverage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.operators import intervals as iv
from reelgrid.operators import timeline as tl
from reelgrid.session import load


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return load(spark, sf_dir, "events").withColumn("ms", ms)


def gap_deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.gap_deficits(_events(spark, sf_dir), ["user_id"], "ms", "event_id", 20.0, 0.0)


def ratio_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.ratio_median(_events(spark, sf_dir), ["user_id"], "ms", "event_id").select("user_id", "n", F.round("ratio", 6).alias("ratio"))


def mad_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.mad_filter(load(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value")


def adaptive_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.round(tl.cutoff(F.col("value")), 6).alias("cutoff"))


def pair_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return load(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.median(v).alias("median"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"),
        F.min(v).alias("low"), F.max(v).alias("high"), F.max_by("event_id", F.struct(v, -F.col("event_id"))).alias("worst"),
    )


def segment_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tl.segment_stats(_events(spark, sf_dir), ["user_id"], "ms", "event_id", 1.0)
    return s.select("user_id", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "low", "high")], "low_accuracy")


def event_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = 30 * 60 * 1000
    ev = _events(spark, sf_dir).select("user_id", (F.col("ms") - half).alias("start_ms"), (F.col("ms") + half).alias("end_ms"))
    return iv.merged(ev, ["user_id"], "start_ms", "end_ms")


def island_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of each user farther than half an hour from any purchase, within the time of the table."""
    half = 30 * 60 * 1000
    ev = _events(spark, sf_dir)
    isles = iv.merged(ev.where("event_type = 'purchase'").select("user_id", (F.col("ms") - half).alias("a"), (F.col("ms") + half).alias("b")), ["user_id"], "a", "b")
    bounds = ev.select("user_id").distinct().crossJoin(F.broadcast(ev.agg(F.min("ms").alias("low"), F.max("ms").alias("high"))))
    return iv.complement(isles, ["user_id"], "a", "b", bounds=bounds)


def frame_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of ids within five of each user's purchases, from 0 to the user's last id; the full range without purchases."""
    ev = load(spark, sf_dir, "events")
    bounds = ev.groupBy("user_id").agg(F.lit(0).cast("bigint").alias("low"), F.max("event_id").alias("high"))
    return iv.ranges_around(ev.where("event_type = 'purchase'"), bounds, ["user_id"], "event_id", 5)


def integer_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("first"), F.col("l_linenumber").alias("last")).distinct()
    return iv.merged(n, ["l_orderkey"], "first", "last", 1).select("l_orderkey", "first", "last")


def clipped_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    a0, a1 = iv.window_around(F.col("event_id"), 500)
    c = iv.clipped(a0, a1, F.lit(1000), F.lit(5000))
    return ev.select("event_id", c.alias("c")).select("event_id", *[F.col(f"c.{x}").cast("bigint").alias(f"{x}_at" if x in ("start", "end") else x) for x in ("start", "end", "missing_before", "missing_after")])


def even_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir, "events").groupBy("user_id").agg((F.max("event_id") - F.min("event_id")).alias("span"))
    return g.select("user_id", F.posexplode(iv.even_starts(F.col("span"), 1000, 3, 10)).alias("i", "start_at"))


def edge_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir)
    ends = ev.agg(F.max("ms").alias("le"), F.max("event_id").alias("re"), F.min("ms").alias("l0"))
    x = ev.crossJoin(F.broadcast(ends)).withColumn("ms", F.col("ms") - F.col("l0")).withColumn("le", F.col("le") - F.col("l0"))
    c = tl.coverage(x, ["user_id"], "ms", "event_id", F.col("le"), F.col("re"), 3_600_000.0)
    return c.withColumn("share", F.round("share", 9))


def constant_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir).withColumn("sec", F.floor(F.col("ms") / 1000))
    c = tl.constant_offset(ev, ["event_type"], "sec", "event_id", 1e6)
    return c.withColumn("sigma", F.round("sigma", 2))


def grid_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir)
    return tl.grid_shift(ev, ["user_id"], F.col("value"), 40.0)


def linear_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir).withColumn("h", F.col("ms") / 3.6e6 - 400000).withColumn("id", F.col("event_id").cast("double"))
    f = tl.linear_fit(ev, ["event_type"], "h", "id")
    return f.select("event_type", *[F.round(c, 2).alias(c) for c in ("slope", "intercept", "span", "res_median", "res_p95")])


def linear_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tl.linear_mapping(_events(spark, sf_dir), ["user_id"], "ms", "event_id", 300.0)
    return m.select("user_id", F.round(F.col("slope") * 1e6, 6).alias("slope"), F.round("worst", 4).alias("worst"))


def dark_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after which the user's next three are all poor; what lies past the end counts as poor."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(1, 3)
    rich = F.max(F.when(F.col("value") > 50, 1).otherwise(0)).over(w)
    return load(spark, sf_dir, "events").select("event_id", (F.coalesce(rich, F.lit(0)) == 0).alias("dark"))


def history_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one of the user's three events before lies within a cutoff of one of the three before of the same type."""
    from pyspark.sql import Window

    past = [F.collect_list("value").over(Window.partitionBy(*by).orderBy("event_id").rowsBetween(-3, -1)) for by in (["user_id"], ["user_id", "event_type"])]
    rows = load(spark, sf_dir, "events").select("event_id", past[0].alias("l"), past[1].alias("r"))
    return rows.select("event_id", tl.history_ok(F.col("l"), F.col("r"), 2.0).alias("seen"))


def edge_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last event of a user, moved to the table's edges when within 60 ids of them."""
    ev = load(spark, sf_dir, "events")
    ends = ev.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    g = ev.groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).crossJoin(F.broadcast(ends))
    a, b = F.when(F.col("a") - F.col("lo") <= 60, F.col("lo")).otherwise(F.col("a")), F.when(F.col("hi") - F.col("b") <= 60, F.col("hi")).otherwise(F.col("b"))
    return g.select("user_id", a.alias("first_id"), b.alias("last_id"))


def interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of each event by the line between the purchases around it, the nearest one outside."""
    from pyspark.sql import Window

    k = F.when(F.col("event_type") == "purchase", F.struct("event_id", "value"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    lo, hi = F.last(k, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(k, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    x = load(spark, sf_dir, "events").select("event_id", "user_id", lo.alias("lo"), hi.alias("hi"))
    t = (F.col("event_id") - F.col("lo.event_id")) / F.nullif(F.col("hi.event_id") - F.col("lo.event_id"), F.lit(0))
    v = F.coalesce(F.col("lo.value") + t * (F.col("hi.value") - F.col("lo.value")), F.col("lo.value"), F.col("hi.value"))
    return x.select("event_id", F.round(v, 6).alias("value"))


def rogue_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir).select("user_id", "event_id", (F.col("ms") / 1e6).alias("x"))
    return tl.masked(ev, ["user_id"], "x", "event_id", lambda l, r: tl.drop_rogues(l, r, 20.0))


def strict_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir).select("user_id", "event_id", F.floor("value").alias("v"))
    return tl.masked(ev, ["user_id"], "event_id", "v", tl.strict_mapping)


def ransac_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir).select("user_id", "event_id", (F.col("ms") / 1e6).alias("x"))
    return tl.masked(ev, ["user_id"], "x", "event_id", lambda l, r: tl.ransac_inliers(l, r, 200.0))


def boundary_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_id")
        at = tl.walk_boundary((pdf.value > 20).to_numpy(), (pdf.event_type != "error").to_numpy(), 0, 4, 2, 3)
        return pd.DataFrame({"user_id": pdf.user_id.iloc[:1], "reached": pdf.event_id.iloc[at : at + 1].to_numpy()})

    return ev.groupBy("user_id").applyInPandas(run, "user_id bigint, reached bigint")


def short_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events").select("user_id", "event_id", "value")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_id")
        v, ids = pdf.value.to_numpy(), pdf.event_id.to_numpy()
        parts = tl.merge_short(v, 500.0)
        return pd.DataFrame({"user_id": pdf.user_id.iloc[0], "first_id": ids[[a for a, _ in parts]], "n": np.array([b - a for a, b in parts], dtype=np.int64)})

    return ev.groupBy("user_id").applyInPandas(run, "user_id bigint, first_id bigint, n bigint")


def global_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation of each user's event numbers to hours of 11.5 frames."""
    ev = _events(spark, sf_dir).select("user_id", "event_id", (F.col("ms") / 1000 / 258).alias("x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_id")
        x = pdf.x.to_numpy() - pdf.x.min()
        kind, slope, _ = tl.relation(x, pdf.event_id.to_numpy(float), sigma=10.0, res_median=60.0, res_p95=250.0)
        return pd.DataFrame({"user_id": pdf.user_id.iloc[:1], "relation": [kind], "slope": [None if np.isnan(slope) else round(slope, 3)]})

    return ev.groupBy("user_id").applyInPandas(run, "user_id bigint, relation string, slope double")


def extrapolated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks paired with views: the known pairs are every third click with the next view, the others are predicted."""
    ev = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.sort(pdf.event_id[pdf.event_type == "click"].to_numpy(float))
        b = np.sort(pdf.event_id[pdf.event_type == "view"].to_numpy(float))
        at = np.searchsorted(b, a[::3])
        ok = at < len(b)
        got = tl.extrapolate(a[::3][ok], b[at[ok]], a, b, lambda x, y: abs(x - y), 400.0)
        return pd.DataFrame({"user_id": np.int64(pdf.user_id.iloc[0]), "click_id": np.array([int(x) for x, _ in got], dtype=np.int64), "view_id": np.array([int(y) for _, y in got], dtype=np.int64)})

    return ev.groupBy("user_id").applyInPandas(run, "user_id bigint, click_id bigint, view_id bigint")


_ALL = (
    gap_deficits, ratio_median, mad_filter, adaptive_cutoff, pair_statistics, segment_statistics, event_islands, island_complement, frame_ranges, integer_ranges, clipped_windows,
    even_segments, edge_coverage, constant_offset, grid_shift, linear_relation, linear_mapping, dark_zones, history_check, edge_snap, interpolated,
    rogue_removal, strict_mapping, ransac_inliers, boundary_walk, short_segments, global_relation, extrapolated_pairs,
)
QUERIES = {f.__name__: f for f in _ALL}

_E = "e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)"
_S = f"""{_E}, s AS (SELECT *, lead(ms) OVER w AS nl, lead(event_id) OVER w AS nr, lead(ms) OVER w - ms AS dl, lead(event_id) OVER w - event_id AS dr
    FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id))"""
_I = f"""{_E}, i AS (SELECT user_id, ms - 1800000 AS a, ms + 1800000 AS b FROM e),
    f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM i),
    g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isle FROM f),
    m AS (SELECT user_id, min(a) AS start_ms, max(b) AS end_ms, count(*) AS n FROM g GROUP BY user_id, isle)"""
ORACLES = {
    "gap_deficits": f"""WITH {_S}, k AS (SELECT user_id, median(dr / dl) AS slope, count(*) AS n FROM s WHERE dl > 0 GROUP BY 1)
        SELECT user_id, ms AS l0, nl AS l1, event_id AS r0, nr AS r1, CAST(round_even(dl * slope - dr, 0) AS BIGINT) AS deficit FROM s JOIN k USING (user_id)
        WHERE k.n >= 2 AND dl IS NOT NULL AND abs(round_even(dl * slope - dr, 0)) > 20""",
    "ratio_median": f"WITH {_S} SELECT user_id, count(*) FILTER (dr <> 0) AS n, round(coalesce(median(dl / nullif(dr, 0)), 'nan'::DOUBLE), 6) AS ratio FROM s GROUP BY 1",
    "mad_filter": """WITH m AS (SELECT event_type, median(value) AS med, count(*) AS n FROM events GROUP BY 1),
            d AS (SELECT event_type, median(abs(value - med)) AS mad FROM events JOIN m USING (event_type) GROUP BY 1)
        SELECT event_id, event_type, value FROM events JOIN m USING (event_type) JOIN d USING (event_type) WHERE n <= 3 OR value <= med + 1.5::DOUBLE * mad""",
    "adaptive_cutoff": "SELECT event_type, round(greatest(median(value) + 2 * stddev_pop(value), 16), 6) AS cutoff FROM events GROUP BY 1",
    "pair_statistics": """SELECT user_id, count(*) AS n, median(value) AS median, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS low, max(value) AS high,
        first(event_id ORDER BY value DESC, event_id) AS worst FROM events GROUP BY 1""",
    "segment_statistics": f"""WITH {_S} SELECT user_id, count(*) AS n, round(avg(dl / dr), 4) AS mean, round(median(dl / dr), 4) AS median, round(min(dl / dr), 4) AS low, round(max(dl / dr), 4) AS high,
        coalesce(2.0 / nullif(least(min(dl), min(dr)), 0) > 0.1, true) AS low_accuracy FROM s WHERE dr > 0 GROUP BY 1""",
    "event_islands": f"WITH {_I} SELECT * FROM m",
    "island_complement": f"""WITH {_I.replace("FROM e)", "FROM e WHERE event_type = 'purchase')")}, t AS (SELECT min(ms) AS lo, max(ms) AS hi FROM e),
            c AS (SELECT user_id, lag(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms) + 1 AS gap_start, start_ms - 1 AS gap_end FROM m
                UNION ALL SELECT u.user_id, lo, coalesce(min(start_ms) - 1, hi) FROM (SELECT DISTINCT user_id FROM e) u CROSS JOIN t LEFT JOIN m USING (user_id) GROUP BY u.user_id, lo, hi
                UNION ALL SELECT user_id, max(end_ms) + 1, hi FROM m, t GROUP BY user_id, hi)
        SELECT * FROM c WHERE gap_start <= gap_end""",
    "frame_ranges": """WITH u AS (SELECT user_id, max(event_id) AS hi, bool_or(event_type = 'purchase') AS any_p FROM events GROUP BY 1),
            n AS (SELECT DISTINCT user_id, unnest(range(greatest(0, event_id - 5), least(hi, event_id + 5) + 1)) AS n FROM events JOIN u USING (user_id) WHERE event_type = 'purchase'),
            g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS grp FROM n)
        SELECT user_id, min(n) AS first, max(n) AS last FROM g GROUP BY user_id, grp UNION ALL SELECT user_id, 0, hi FROM u WHERE NOT any_p""",
    "integer_ranges": """WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem), g AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS grp FROM d)
        SELECT l_orderkey, min(n) AS first, max(n) AS last FROM g GROUP BY l_orderkey, grp""",
    "clipped_windows": """WITH w AS (SELECT event_id, greatest(0, event_id - 500) AS a, event_id + 500 AS b FROM events)
        SELECT event_id, greatest(a, 1000) AS start_at, greatest(greatest(a, 1000), least(b, 5000)) AS end_at, greatest(0, least(1000, b) - a) AS missing_before, greatest(0, b - greatest(5000, a)) AS missing_after FROM w""",
    "even_segments": """WITH g AS (SELECT user_id, max(event_id) - min(event_id) AS span FROM events GROUP BY 1), n AS (SELECT *, greatest(3, least(10, span // 1000)) AS n FROM g),
            x AS (SELECT *, unnest(range(0, n)) AS i FROM n)
        SELECT user_id, CAST(i AS INTEGER) AS i, CAST(round_even(i * (span / n), 0) AS BIGINT) AS start_at FROM x""",
    "edge_coverage": f"""WITH {_E}, b AS (SELECT max(ms) - min(ms) AS le, max(event_id) AS re, min(ms) AS l0 FROM e), x AS (SELECT user_id, ms - l0 AS ms, event_id, le, re FROM e, b),
            g AS (SELECT user_id, min(ms) AS f, max(ms) AS t, arg_min(event_id, (ms, event_id)) AS fr, arg_max(event_id, (ms, event_id)) AS tr, max(le) AS le, max(re) AS re FROM x GROUP BY 1)
        SELECT user_id, f AS l_head, fr AS r_head, le - t AS l_tail, re - tr AS r_tail, round((t - f) / le, 9) AS share,
            greatest(f, fr) <= 7200000 AND greatest(le - t, re - tr) - 3600000 <= 7200000 AS full_coverage FROM g""",
    "constant_offset": f"""WITH {_E}, d AS (SELECT event_type, event_id - CAST(floor(ms / 1000) AS BIGINT) AS d FROM e)
        SELECT event_type, round(stddev_pop(d), 2) AS sigma, CAST(round_even(median(d), 0) AS BIGINT) AS "offset", count(*) AS n, stddev_pop(d) <= 1e6 AS constant FROM d GROUP BY 1""",
    "grid_shift": """WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1)
        SELECT user_id, CAST(CASE WHEN abs(m - round_even(m / 40.0::DOUBLE, 0) * 40) <= 10 THEN round_even(m, 0) ELSE 0 END AS BIGINT) AS shift FROM m""",
    "linear_relation": f"""WITH {_E}, x AS (SELECT event_type, ms / 3.6e6 - 400000 AS h, CAST(event_id AS DOUBLE) AS id FROM e),
            f AS (SELECT event_type, regr_slope(id, h) AS s, regr_intercept(id, h) AS i, max(h) - min(h) AS span FROM x GROUP BY 1)
        SELECT event_type, round(any_value(s), 2) AS slope, round(any_value(i), 2) AS intercept, round(any_value(span), 2) AS span, round(median(abs(id - (s * h + i))), 2) AS res_median,
            round(quantile_cont(abs(id - (s * h + i)), 0.95), 2) AS res_p95 FROM x JOIN f USING (event_type) GROUP BY 1""",
    "linear_mapping": f"""WITH {_E}, f AS (SELECT user_id, min(ms) AS l0, max(ms) AS l1, arg_min(event_id, (ms, event_id)) AS r0, arg_max(event_id, (ms, event_id)) AS r1 FROM e GROUP BY 1),
            k AS (SELECT *, (r1 - r0) / nullif(l1 - l0, 0) AS slope FROM f), w AS (SELECT user_id, any_value(slope) AS slope, max(abs(event_id - (r0 + slope * (ms - l0)))) AS worst FROM e JOIN k USING (user_id) GROUP BY 1)
        SELECT user_id, round(CASE WHEN slope > 0 AND worst <= 300 THEN slope END * 1e6, 6) AS slope, round(worst, 4) AS worst FROM w""",
    "dark_zones": "SELECT event_id, coalesce(max(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) = 0 AS dark FROM events",
    "history_check": """WITH h AS (SELECT event_id, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b, lag(value, 3) OVER w AS c, lag(value, 1) OVER v AS x, lag(value, 2) OVER v AS y, lag(value, 3) OVER v AS z
            FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id), v AS (PARTITION BY user_id, event_type ORDER BY event_id))
        SELECT event_id, CASE WHEN c IS NULL AND z IS NULL THEN true WHEN c IS NOT NULL AND z IS NOT NULL
            THEN least(abs(a - x), abs(a - y), abs(a - z), abs(b - x), abs(b - y), abs(b - z), abs(c - x), abs(c - y), abs(c - z)) <= 2 END AS seen FROM h""",
    "edge_snap": """WITH b AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events), g AS (SELECT user_id, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY 1)
        SELECT user_id, CASE WHEN g.a - lo <= 60 THEN lo ELSE g.a END AS first_id, CASE WHEN hi - g.b <= 60 THEN hi ELSE g.b END AS last_id FROM g, b""",
    "interpolated": """WITH k AS (SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER p AS li, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER p AS lv,
            first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER n AS hi, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER n AS hv FROM events
            WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT event_id, round(coalesce(lv + (event_id - li) / nullif(hi - li, 0) * (hv - lv), lv, hv), 6) AS value FROM k""",
}
