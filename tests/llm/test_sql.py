"""The text operators that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from swathe import llm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = llm.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(llm.ORACLES[name])
    at = [[d[0] for d in want.description].index(c) for c in cols]
    assert sorted(tuple(map(str, (r[c] for c in cols))) for r in got.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def test_all_operators_are_registered():
    names = [next(n for n in llm.QUERIES if n.startswith(f"op{k}_")) for k in range(1, 14)]
    assert len(names) == len(llm.QUERIES) == 13
