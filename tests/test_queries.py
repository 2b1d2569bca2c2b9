"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from weftline.plans import contested, queries, streams  # noqa: F401

SF = "/root/testdata/sf0.001"


def canonical(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]

    def text(x):
        return str(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in queries.ORACLE:
        want = duck.sql(queries.ORACLE[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert canonical(got, df.columns) == canonical(want.fetchall(), want.columns)
    else:
        assert got
