"""The operators that SQL can say, against DuckDB at sf0.001."""

import os

import duckdb
import pytest

from reelgrid.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_operator_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = c.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    at = [cols.index(x) for x in df.columns]
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr) and got
