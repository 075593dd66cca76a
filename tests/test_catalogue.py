"""Every catalogue query against its SQL twin."""

import duckdb
import pytest

from tests.conftest import DATA
from tidepool.plans import catalogue, indexes, upkeep  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_twin(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    twin = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in twin.description]
    assert sorted(names) == columns
    assert got == sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in twin.fetchall()], key=repr)


def test_partitioning_changes_nothing(spark):
    docs = catalogue.read(spark, DATA, "documents")
    want = [tuple(r) for r in catalogue.top50(docs).select("doc_id", "lexical_score").collect()]
    for n in (1, 7, 64):
        assert [tuple(r) for r in catalogue.top50(docs.repartition(n)).select("doc_id", "lexical_score").collect()] == want


def test_flagship_plan_is_a_topk(spark, capsys):
    catalogue.QUERIES["lexical_topk"](spark, DATA).explain()
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "Cartesian" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
