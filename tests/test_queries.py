"""Every registered query against its SQL in DuckDB, or for its rows where SQL can't express it."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from barweave.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "hour"):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "as_integer_ratio"):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    return v.isoformat() if hasattr(v, "isoformat") else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, con, name):
    df = catalog.queries()[name](spark, sf_dir)
    rows = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    wanted = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(wanted.columns)
    places = [wanted.columns.index(c) for c in columns]
    assert ordered([[r[c] for c in columns] for r in rows]) == ordered([[r[i] for i in places] for r in wanted.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).limit(3).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
