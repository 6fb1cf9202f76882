"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from quern import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark conversations labels".split()
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)[:10]
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    assert sorted(df.columns) == sorted(columns)
    order = [df.columns.index(c) for c in sorted(columns)]
    other = [columns.index(c) for c in sorted(columns)]
    a = sorted(([plain(r[i]) for i in order] for r in got), key=repr)
    b = sorted(([plain(r[i]) for i in other] for r in want), key=repr)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
