"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def rows(frame, columns):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v

    return sorted(([cell(r[c]) for c in columns] for r in frame), key=str)


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(entry.SQL[name])
    got = entry.QUERIES[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    expected = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert rows([r.asDict() for r in got.collect()], columns) == rows(expected, columns)


def test_all_have_sql():
    assert set(entry.SQL) == set(entry.QUERIES)
