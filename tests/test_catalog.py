"""Every query of the reference's operators against its SQL in DuckDB, on the smallest data."""

import decimal

import duckdb
import pytest

from quarry.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def norm(x):
    if isinstance(x, float):
        return repr(round(x, 6))
    return f"D{x}" if isinstance(x, decimal.Decimal) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, data, name):
    df = catalog.queries()[name](spark, data)
    columns = sorted(df.columns)
    ours = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(catalog.oracle_sql()[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == columns
    assert ours == sorted(tuple(norm(r[theirs.index(c)]) for c in columns) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0


def test_flagship(spark, data):
    rows = catalog.flagship(spark, data).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows
