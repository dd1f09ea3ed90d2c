"""Every query with SQL gives the same rows in Spark and in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tandem import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    try:
        return float(value)
    except (TypeError, ValueError):
        return str(value)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5))


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)), round(x, 3) if isinstance(x, float) else x) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_duckdb(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in names) for r in df.collect()])
    result = duck.execute(catalog.oracle_sql()[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == names
    want = ordered([tuple(plain(dict(zip(found, r, strict=True))[c]) for c in names) for r in result.fetchall()])
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))
