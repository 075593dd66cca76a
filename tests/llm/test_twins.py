"""The corpus queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from tests.conftest import DATA
from tests.test_catalogue import TABLES, plain
from tidepool.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    twin = duck.execute(ORACLES[name])
    names = [d[0] for d in twin.description]
    assert sorted(names) == columns
    assert got == sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in twin.fetchall()], key=repr)
