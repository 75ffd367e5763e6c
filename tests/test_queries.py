"""Every registered query against its reference SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from titleloom.plans.oracles import ORACLES
from titleloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    want = normal(columns, result.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, df.collect()) == want
    assert want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
