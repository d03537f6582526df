"""Every registered query with SQL against DuckDB on the same tables; the others for rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from panelspark.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return v.isoformat() if hasattr(v, "isoformat") else v

    return sorted((tuple(str(cell(r[i])) for i in order) for r in rows)), sorted(columns)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf)
    rel = duck.sql(plans.ORACLES[name])
    want = canonical(rel.fetchall(), rel.columns)
    have = canonical([tuple(r) for r in got.collect()], got.columns)
    assert have[1] == want[1]
    assert len(have[0]) == len(want[0])
    assert [p for p in zip(have[0], want[0]) if p[0] != p[1]][:5] == []


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_rows(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_repository_holds_no_data():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    assert not [f for _, _, names in os.walk(root) for f in names if f.endswith((".parquet", ".csv"))]
