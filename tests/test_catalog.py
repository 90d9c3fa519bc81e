import math
import os

import duckdb
import pytest

from hushframe import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in catalog.TABLES:
        path = f"{DATA}/{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def text(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows_are_those_of_the_oracle(spark, duck, name):
    mine = catalog.QUERIES[name](spark, DATA)
    cursor = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(mine.columns) == sorted(columns)
    want = sorted(tuple(text(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall())
    assert sorted(tuple(text(r[c]) for c in sorted(columns)) for r in mine.collect()) == want


def test_whole_tables_are_joined_and_expanded(spark):
    rows = catalog.QUERIES["full_join_whole"](spark, DATA).collect()
    for column, table, key in (("o", "orders", "o_orderkey"), ("c", "customer", "c_custkey")):
        assert {r[column] for r in rows} - {None} == {r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()}
    assert catalog.QUERIES["bucket_expansion_whole"](spark, DATA).count() > 5 * catalog.QUERIES["bucket_expansion"](spark, DATA).count()
