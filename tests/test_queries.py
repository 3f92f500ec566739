"""Every query with SQL against DuckDB at sf0.001, compared as the driver does."""

import os
from itertools import zip_longest

import duckdb
import pytest

from reelgrid import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLES:
        assert got
        return
    cur = duck.execute(registry.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in df.columns]
    want = [tuple(r[i] for i in at) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, repr(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert got or name in ("hash_within",)


def rows_by_any(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def rows_by(df, *cols):
    return sorted(rows_by_any(df, *cols))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_two_stage_match_takes_every_customer(spark, duck):
    sup, cust = (duck.execute(q).fetchall() for q in ("SELECT s_suppkey, s_nationkey FROM supplier ORDER BY 1", "SELECT c_custkey, c_nationkey FROM customer ORDER BY 1"))
    lone = lambda side: {k: v[0] for k in {k for _, k in side} if len(v := [i for i, x in side if x == k]) == 1}
    a, b = lone(sup), lone(cust)
    want = [(a[k], b[k], "key") for k in a.keys() & b.keys()]
    left, right = ([i for i, _ in side if i not in {w[at] for w in want}] for at, side in enumerate((sup, cust)))
    want += [(x, y, "unmatched" if x is None or y is None else "order") for x, y in zip_longest(left, right)]
    by_text = lambda rows: sorted(rows, key=str)
    assert by_text(rows_by_any(registry.QUERIES["two_stage_match"](spark, SF), "s_suppkey", "c_custkey", "stage")) == by_text(want)


@pytest.fixture
def late_events(spark, tmp_path):
    """Twelve events a user, some beyond 100 hours."""
    ids = [*range(8), 999, 1000, 359_999, 360_000]
    rows = [(i * 2 + u, u, f"type{i % 3}") for u in (0, 1) for i in ids]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path), rows


def test_timed_text_parses_every_event(spark, late_events):
    sf_dir, rows = late_events
    assert rows_by(registry.QUERIES["timed_text"](spark, sf_dir), "user_id", "start_ms", "text") == sorted((u, i * 1000, t) for i, u, t in rows)


def test_subtitle_parse_parses_every_event(spark, late_events):
    sf_dir, rows = late_events
    assert rows_by(registry.QUERIES["subtitle_parse"](spark, sf_dir), "user_id", "start_ms", "end_ms", "text") == sorted((u, i * 1000, i * 1000 + 500, t) for i, u, t in rows)


def hashes(duck):
    """(vec_id, label, sign bits) by vec_id."""
    return [(i, k, sum(int(x > 0) << j for j, x in enumerate(e))) for i, k, e in duck.execute("SELECT vec_id, label, embedding FROM embeddings ORDER BY 1").fetchall()]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("block", [None, 30])
def test_hash_nearest_asks_for_every_vector(spark, duck, block):
    v = hashes(duck)
    want = [(i, *min(((h ^ g).bit_count(), o) for o, _, g in v if o != i)) for i, _, h in v]
    if block is None:
        got = registry.QUERIES["hash_nearest"](spark, SF)
    else:
        from reelgrid.operators import matching as mt

        rows = spark.createDataFrame([(i, h - (1 << 64) if h >> 63 else h) for i, _, h in v] + [(-1, None)], "vec_id bigint, h bigint")
        got = mt.nearest_other(rows, "vec_id", "h", block)
    assert rows_by(got, "vec_id", "distance", "other") == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_best_neighbour_takes_every_pair_of_labels(spark, duck):
    at = {}
    for _, k, h in hashes(duck):
        at.setdefault(k, []).append(h)
    want = []
    for k, left in at.items():
        right = at.get(k + 1, [])
        for p in range(len(left)):
            near = lambda side: range(max(p - 1, 0), min(p + 2, len(side)))  # noqa: B023, E731
            tried = [((left[x] ^ right[y]).bit_count(), x + 1, y + 1) for x in near(left) for y in near(right)]
            want += [(k, p + 1, *min(tried))] if tried else []
    assert len({w[0] for w in want}) > 1
    assert rows_by(registry.QUERIES["best_neighbour"](spark, SF), "label", "l_at", "distance", "l", "r") == sorted(want)


def test_registry_is_consistent():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
