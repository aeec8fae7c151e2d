"""Every query with SQL against its SQL, on the smallest tables and on a table of odd rows."""

import glob
import os

import duckdb
import pytest

from cadence.llm.queries import ORACLES, QUERIES
from tests.test_queries import plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want
