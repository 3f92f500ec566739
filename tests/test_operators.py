"""Fixed golden rows for the rules that the tables don't show: NULLs, ties, walks, odd texts."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelgrid.functions import scalars as sc
from reelgrid.operators import election as el
from reelgrid.operators import grouping as gr
from reelgrid.operators import intervals as iv
from reelgrid.operators import matching as mt
from reelgrid.operators import timeline as tl
from reelgrid.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "column,expected",
    [
        (lambda: sc.time_to_ms(F.lit("00:00:01.5")), 1005),
        (lambda: sc.time_to_ms(F.lit("01:02:03,4567")), 3723456),
        (lambda: sc.time_to_ms(F.lit("1:2")), None),
        (lambda: sc.ms_to_time(F.lit(3723456)), "01:02:03,456"),
        (lambda: sc.rate(F.lit("30000/1001")), 30000 / 1001),
        (lambda: sc.rate(F.lit("25")), 25.0),
        (lambda: sc.rate(F.lit("0/0")), None),
        (lambda: sc.seconds_to_ms(F.lit("0.0005")), 0),
        (lambda: sc.seconds_to_ms(F.lit("x")), None),
        (lambda: sc.unify_language(F.lit("GER")), "deu"),
        (lambda: sc.unify_language(F.lit("und")), None),
        (lambda: sc.language_name(F.lit(None).cast("string")), "Unknown"),
        (lambda: sc.path_stem(F.lit("/a/b.c/film.cd1.mkv")), "film.cd1"),
        (lambda: sc.path_stem(F.lit("/a/.hidden")), ".hidden"),
        (lambda: sc.path_ext(F.lit("/a.b/noext")), ""),
        (lambda: sc.is_video(F.lit("x/Y.MKV")), True),
        (lambda: sc.relative_path(F.lit("/a/b/c"), F.lit("/a/")), "b/c"),
        (lambda: sc.relative_path(F.lit("/ab/c"), F.lit("/a")), "/ab/c"),
        (lambda: sc.truthy(F.lit(" Yes ")), True),
        (lambda: sc.truthy(F.lit(None).cast("string")), False),
        (lambda: sc.corrected_ms(F.lit("0.021"), F.lit(-21)), 0),
        (lambda: sc.corrected_ms(F.lit("0.062"), F.lit(-21)), 41),
        (lambda: sc.sync_offset(F.lit(5).cast("bigint"), F.lit(5).cast("bigint")), None),
        (lambda: sc.end_offset(F.lit(-5), F.lit(100), F.lit(7)), 100),
        (lambda: sc.end_offset(F.lit(1), F.lit(None).cast("int"), F.lit(7)), 7),
        (lambda: sc.quoted_list(F.lit('"a b","c\\"d"')), ["a b", 'c"d']),
        (lambda: sc.compact_time(F.lit(3723)), "1:02:03"),
        (lambda: sc.flac_format(F.lit("s16p")), "s16"),
        (lambda: sc.flac_format(F.lit("fltp")), "s32"),
        (lambda: sc.last_score(F.lit("SSIM All:0.9 x\nSSIM Y:1 All:0.975 (16)")), 0.975),
        (lambda: sc.keyword_language(F.lit("pldub")), "pol"),
        (lambda: sc.keyword_language(F.lit("dubbing en")), "eng"),
        (lambda: sc.token_language(F.lit("en")), None),
        (lambda: sc.label_language(F.lit(None).cast("string"), F.lit("/x/film lektor pl.mkv")), "pol"),
        (lambda: sc.subtitle_format(F.lit("a.SRT")), "srt"),
        (lambda: sc.balanced_any([F.lit(False), F.lit(True), F.lit(False)]), True),
        (lambda: el.length_mismatch(F.lit(1), F.lit(None).cast("int")), False),
        (lambda: el.first_issue(("a", F.lit(None).cast("boolean")), ("b", F.lit(True))), "b"),
        (lambda: iv.even_starts(F.lit(90), 30, 3, 10), [0, 30, 60]),
        (lambda: iv.clipped(F.lit(0), F.lit(10), F.lit(3), F.lit(20)), (3, 10, 3, 0)),
    ],
)
def test_scalar_rules(spark, column, expected):
    got = value(spark, column())
    assert (tuple(got) if isinstance(expected, tuple) else got) == expected


def test_priority_order(spark):
    rows = spark.createDataFrame([("xx",), (None,), ("de",), ("fr",), ("",)], "lang string")
    got = {r.lang: r.r for r in rows.select("lang", el.priority_rank(F.col("lang"), ["fr", "de"]).alias("r")).collect()}
    assert got == {"fr": 1, "de": 2, None: 3, "xx": 4, "": 4}


def test_gap_deficit_of_the_known_hole(spark):
    left = [300000 - 10000 * i for i in range(30, -1, -1)] + [310000 + 10000 * i for i in range(30)]
    right = [int(295920 - 9864 * i / 1) for i in range(30, -1, -1)] + [298784 + 9864 * i for i in range(30)]
    pairs = spark.createDataFrame([(1, a, b) for a, b in zip(left, right, strict=True)], "k int, l bigint, r bigint")
    got = [tuple(r) for r in tl.gap_deficits(pairs, ["k"], "l", "r").collect()]
    assert got == [(1, 300000, 310000, 295920, 298784, 7000)]


def test_rogue_point_goes():
    left = np.arange(20) * 10000.0
    right = left.copy()
    right[10] += 60000
    mask = tl.drop_rogues(left, right)
    assert mask.sum() == 19 and not mask[10]
    assert tl.drop_rogues(left, left).all() and tl.drop_rogues(left[:2], right[:2]).all()


def test_strict_mapping_keeps_the_later_of_equal_values():
    mask = tl.strict_mapping(np.array([0, 1, 2, 3, 4.0]), np.array([0, 5, 5, 4, 9.0]))
    assert mask.tolist() == [True, False, True, False, True]


def test_ransac_is_seeded():
    x = np.arange(50.0)
    y = 2 * x
    y[[7, 30]] += 500
    assert np.flatnonzero(~tl.ransac_inliers(x, y, 5.0)).tolist() == [7, 30]


def test_short_segments_merge():
    assert tl.merge_short(np.array([1, 5, 5, 1, 1]), 3) == [(0, 2), (2, 5)]
    assert tl.merge_short(np.array([1.0]), 3) == [(0, 1)]


def test_boundary_walk():
    match = np.array([True] * 17 + [False] * 10)
    assert tl.walk_boundary(np.ones(27, dtype=bool), match, 0, 5, 1, 3) == 16
    rich = np.ones(30, dtype=bool)
    rich[10:16] = False
    assert tl.walk_boundary(rich, np.r_[np.ones(10), np.zeros(6), np.ones(14)].astype(bool), 0, 5, 0, 3) == 29


def test_prefix_join_prefers_the_longest(spark):
    names = spark.createDataFrame([("d", "film 2 en"), ("d", "film"), ("d", "other"), ("e", "film 2")], "dir string, name string")
    stems = spark.createDataFrame([("d", "film", 1), ("d", "film 2", 2)], "dir string, stem string, ord int")
    got = {(r.dir, r.name): r.stem for r in mt.prefix_longest(names, stems, "name", "stem", ["dir"], "ord").collect()}
    assert got == {("d", "film 2 en"): "film 2", ("d", "film"): "film", ("d", "other"): None, ("e", "film 2"): None}


@pytest.fixture(scope="module")
def hashes(spark):
    rng = np.random.default_rng(4)
    a = spark.createDataFrame([(i, int(h)) for i, h in enumerate(rng.integers(-(2**62), 2**62, 30))], "l bigint, lh bigint")
    b = spark.createDataFrame([(i, int(h)) for i, h in enumerate(rng.integers(-(2**62), 2**62, 25))], "r bigint, rh bigint")
    return a, b


def test_greedy_assignment(spark, hashes):
    pairs = mt.distance_pairs(*hashes, "l", "r", "lh", "rh")
    got = sorted(tuple(r) for r in mt.greedy_pairs(pairs, "l", "r", "distance").collect())
    left, right, want = set(), set(), []
    for d, x, y in sorted((r.distance, r.l, r.r) for r in pairs.collect()):
        if x not in left and y not in right:
            left.add(x), right.add(y), want.append((x, y, d))
    assert got == sorted(want)


@pytest.mark.parametrize(("block", "alone"), [(8, 0), (16, 500), (8192, 1 << 26)])
@pytest.mark.parametrize("bits", [1, 4, 62])
def test_greedy_hashes_are_greedy(spark, block, alone, bits):
    """Few bits make many ties; ids occur twice, and some have no hash."""
    rng = np.random.default_rng(bits)
    sides = [[(int(i), int(h)) for i, h in zip(rng.integers(0, 2 * n, n), rng.integers(-(2**bits), 2**bits, n), strict=True)] for n in (50, 37)]
    a = spark.createDataFrame([*sides[0], (900, None), (None, 3)], "l bigint, lh bigint")
    b = spark.createDataFrame([*sides[1], (901, None), (None, 3)], "r bigint, rh bigint")
    got = sorted(tuple(r) for r in mt.greedy_hashes(a, b, "l", "r", "lh", "rh", block, alone).collect())
    left, right, want = set(), set(), []
    for d, x, y in sorted((((g ^ h) % 2**64).bit_count(), x, y) for x, g in sides[0] for y, h in sides[1]):
        if x not in left and y not in right:
            left.add(x), right.add(y), want.append((x, y, d))
    assert got == sorted(want)
    empty = a.where("false")
    assert mt.greedy_hashes(empty, b, "l", "r", "lh", "rh", block, alone).count() == 0
    assert mt.greedy_hashes(a, b.where("false"), "l", "r", "lh", "rh", block, alone).count() == 0


@pytest.mark.parametrize("kinds", [2, 60])
def test_greedy_of_rows_over_several_strips(kinds):
    rng = np.random.default_rng(kinds)
    h = rng.choice(rng.integers(-(2**62), 2**62, kinds), 1100)
    left, right = [(i, int(x)) for i, x in enumerate(h[:700])], [(i, int(x)) for i, x in enumerate(h[700:])]
    rows = pa.table({"side": pa.array([0] * 700 + [1] * 400, pa.int32()), "id": [i for i, _ in left + right], "h": pa.array(h)})
    used, taken, want = set(), set(), []
    for d, x, y in sorted((((g ^ k) % 2**64).bit_count(), x, y) for x, g in left for y, k in right):
        if x not in used and y not in taken:
            used.add(x), taken.add(y), want.append((x, y, d))
    assert sorted(tuple(r.values()) for r in mt._greedy_of_rows((), rows).to_pylist()) == sorted(want)


def test_greedy_query_needs_no_round_for_each_tie(spark, tmp_path):
    """Equal vectors tie in every pair, so rounds of pairs that are best for both ends take one pair each."""
    from reelgrid.plans import joins

    rows = [(i, [1.0] * 64, i % 2) for i in range(24)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    sc = spark.sparkContext
    sc.setJobGroup("greedy ties", "")
    try:
        got = sorted(tuple(r) for r in joins.greedy_pairs(spark, str(tmp_path)).collect())
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == [(i, i + 1, 0) for i in range(0, 24, 2)]
    assert len(sc.statusTracker().getJobIdsForGroup("greedy ties")) < 15


@pytest.mark.parametrize("most", [0, 5, 25, 40])
def test_bounded_distance_is_exact(hashes, most):
    pairs = {tuple(r) for r in mt.distance_pairs(*hashes, "l", "r", "lh", "rh").collect() if r.distance <= most}
    assert {tuple(r) for r in mt.distance_pairs(*hashes, "l", "r", "lh", "rh", most).collect()} == pairs


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 9)), min_size=1, max_size=12), st.integers(0, 2))
def test_islands_and_gaps(spark, parts, reach):
    rows = spark.createDataFrame([(1, a, a + n) for a, n in parts], "k int, a int, b int")
    want = []
    for a, b in sorted((a, a + n) for a, n in parts):
        if want and a <= want[-1][1] + reach:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    isles = iv.merged(rows, ["k"], "a", "b", reach)
    got = sorted([r.a, r.b] for r in isles.collect())
    assert got == want
    gaps = sorted((r.gap_start, r.gap_end) for r in iv.complement(isles, ["k"], "a", "b").collect())
    assert gaps == [(x[1] + 1, y[0] - 1) for x, y in zip(want, want[1:], strict=False) if x[1] + 1 <= y[0] - 1]


def test_forced_rows_win(spark):
    rows = spark.createDataFrame([("k", "a", 1, 5, False), ("k", "a", 2, 6, False), ("k", "b", 3, 1, True)], "k string, src string, id int, q int, f boolean")
    assert sorted(r.id for r in el.elected(rows, ["k"], "src", [F.col("q")], F.col("id")).collect()) == [1, 2]
    assert [r.id for r in el.elected(rows, ["k"], "src", [F.col("q")], F.col("id"), F.col("f")).collect()] == [3]


@pytest.mark.parametrize(
    "isles,want",
    [([(10, 20), (30, 40)], [(0, 9), (21, 29), (41, 50)]), ([], [(0, 50)]), ([(0, 50)], []), ([(-5, 3), (48, 99)], [(4, 47)])],
)
def test_complement_reaches_the_bounds(spark, isles, want):
    rows = spark.createDataFrame([("k", a, b) for a, b in isles], "k string, a bigint, b bigint")
    bounds = spark.createDataFrame([("k", 0, 50)], "k string, low bigint, high bigint")
    assert sorted((r.gap_start, r.gap_end) for r in iv.complement(rows, ["k"], "a", "b", bounds=bounds).collect()) == want


def test_ranges_around_points(spark):
    bounds = spark.createDataFrame([("k", 0, 30), ("none", 0, 7)], "k string, low bigint, high bigint")
    points = spark.createDataFrame([("k", 2), ("k", 13), ("k", 29)], "k string, at bigint")
    assert sorted(tuple(r) for r in iv.ranges_around(points, bounds, ["k"], "at", 5).collect()) == [("k", 0, 18), ("k", 24, 30), ("none", 0, 7)]


@pytest.mark.parametrize(
    "path,want",
    [
        ("/m/film CD1.avi", ("/m/film.avi", 1)), ("/m/film/cd12.mp4", ("/m/film/film.mp4", 12)), ("/m/film-cd2.RMVB", ("/m/film.mkv", 2)), ("/m/filmcd1.avi", None),
        ("/m/film cd.avi", None), ("/m/a cd1 b cd2.avi", ("/m/a cd1 b.avi", 2)),
    ],
)
def test_split_part(spark, path, want):
    got = value(spark, sc.split_part(F.lit(path)))
    assert (tuple(got) if got else None) == want


def test_split_plan_fails_as_a_whole(spark):
    paths = ["/m/a cd1.avi", "/m/a cd2.avi", "/m/b cd1.avi", "/m/b cd3.avi", "/m/c.avi"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert gr.split_plan(rows, "path").count() == 0
    assert [r.name for r in gr.split_plan(rows, "path", True).collect()] == ["/m/a.avi"]
    assert [[x.part for x in r.parts] for r in gr.split_plan(rows.where("path like '/m/a%'"), "path").collect()] == [[1, 2]]
    assert gr.split_plan(rows.where("false"), "path").count() == 0


def test_unknown_codes_can_be_errors(spark):
    assert value(spark, sc.unify_language(F.lit("und"), strict=True)) is None
    assert value(spark, sc.unify_language(F.lit("fin"), strict=True)) == "fin"
    with pytest.raises(Exception, match="unknown language code"):
        value(spark, sc.unify_language(F.lit("qq"), strict=True))


def test_subtitle_texts(spark):
    srt = "\r\n1\r\n00:00:01,000 --> 00:00:02,500\r\na\r\nb\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\nc\r\n"
    got = value(spark, files.srt_events(F.lit(srt)))
    assert [tuple(e) for e in got] == [(1000, 2500, "a\nb"), (3000, 4000, "c")]
    assert value(spark, files.srt_events(F.lit(""))) == []
    assert [tuple(e) for e in value(spark, files.timed_lines(F.lit("00:00:01:a\nx\n00:00:10:j")))] == [(1000, "a"), (10000, "j")]


def test_probe_documents(spark):
    js = '{"streams":[{"index":0,"codec_type":"video","codec_name":"hevc","r_frame_rate":"30000/1001","width":3840,"height":2160,"duration":"3.403"},{"index":"1","codec_type":"audio","channels":2,"tags":{"language":"ger","DURATION":"00:00:03.4"}}]}'
    d = spark.createDataFrame([("a", js), ("b", "broken"), ("c", None)], "path string, json string")
    got = files.probe_streams(d, "path", "json").orderBy("tid").collect()
    assert [(r.tid, r.stype, r.language, r.length_ms, r.width) for r in got] == [(0, "video", None, 3403, 3840), (1, "audio", "deu", 3004, None)]


def test_listing_and_pruning(spark, tmp_path):
    for p in ("a/film.mkv", "a/sub/x.srt", "b/c/y.srt", "z.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    found = files.listing(spark, str(tmp_path))
    assert {(r.stem, r.ext) for r in found.collect()} == {("film", "mkv"), ("x", "srt"), ("y", "srt"), ("z", "txt")}
    left = files.prune_below(found, found.where(sc.is_video(F.col("path"))))
    assert {r.stem for r in left.collect()} == {"y", "z"}


def test_frame_times_keep_the_last(spark):
    lines = spark.createDataFrame([(0, "x n:   0 pts_time:0.021"), (1, "n: 1 pts_time:0.062"), (2, "n: 2 pts_time:0.0621"), (3, "noise")], "i int, line string")
    assert {(r.ts_ms, r.frame_id) for r in files.frame_times(lines, "line", "i", -21).collect()} == {(0, 0), (41, 2)}


def test_provider_ids_and_cache(spark):
    items = spark.createDataFrame([("m", {"Tmdb": "1", "TmdbCollection": "2"})], "name string, ids map<string,string>")
    assert [tuple(r) for r in files.provider_ids(items, "name", "ids").collect()] == [("m", "Tmdb", "1")]
    cache = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    got = files.upsert(cache, spark.createDataFrame([(2, "c")], "id int, v string"), ["id"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c")]


def test_mad_keeps_small_groups(spark):
    rows = spark.createDataFrame(pd.DataFrame({"k": [1] * 3 + [2] * 5, "v": [1.0, 2.0, 900.0, 1.0, 2.0, 2.0, 3.0, 99.0]}))
    assert sorted(r.v for r in tl.mad_filter(rows, ["k"], "v").collect()) == [1.0, 1.0, 2.0, 2.0, 2.0, 3.0, 900.0]


def test_relations_of_time_lines():
    x = np.arange(0.0, 2000, 40)
    assert tl.relation(x, x + 12) == ("constant", 1.0, 12.0)
    kind, k, b = tl.relation(x, x * 1.04 + 5)
    assert kind == "linear" and k == pytest.approx(1.04) and b == pytest.approx(5)
    bad = x * 1.04
    bad[::3] += 700
    assert tl.relation(x, bad)[0] == "none"  # too many outliers
    assert tl.relation(x, x * 1.5)[0] == "none"  # too far from 1
    assert tl.relation(x, x * 25 / 24, 25 / 24)[0] == "linear"
    assert tl.relation(x[:2], x[:2])[0] == "none" and tl.relation(x[[0, 20]], x[[0, 20]])[0] == "constant"


def test_extrapolated_pairs():
    known = np.array([0.0, 100, 200])
    pool = np.array([50.0, 150, 250])
    got = tl.extrapolate(known, known + 7, pool, np.array([57.0, 158, 400]), lambda a, b: 0, 1)
    assert got == [(0, 7), (50, 57), (100, 107), (150, 158), (200, 207)]
    assert tl.extrapolate(known, known + 7, pool, pool + 7, lambda a, b: 99, 16) == [(0, 7), (100, 107), (200, 207)]


def test_ordinals_run_over_the_whole_table(spark):
    d = spark.range(0, 3000, 3).repartition(7).toDF("k")
    assert all(r.pos == r.k // 3 + 1 for r in mt.ordinals(d, "k").collect())
    assert mt.ordinals(d.limit(0), "k").count() == 0
