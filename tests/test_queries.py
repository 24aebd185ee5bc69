"""Every query with SQL equals DuckDB's answer on the smallest tables; the others have rows."""

import decimal
import math

import duckdb
import pytest

from quillframe.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return (2, "")
        if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
            return (0, "nan" if math.isnan(v) else f"{float(v):.9g}")
        return (1, str(v))

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical(rows, df.columns) == canonical(want.fetchall(), want.columns)
