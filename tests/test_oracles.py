"""Every registered query with an oracle equals its DuckDB SQL (row count,
column names and an order-insensitive hash of the values)."""

import hashlib
import math
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from platewise.sources.testdata import TABLES

from conftest import SF_SMALL

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from compare import type_differences  # noqa: E402

ORACLES = entry.oracle_sql()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if math.isinf(v):
            return v
        r = round(v, 6)
        return 0.0 if r == 0 else r
    return v


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keys = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(keys).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    def make():
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
        return c

    return make


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con().execute(ORACLES[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert type_differences(df, con(), ORACLES[name]) == {}
    assert len(rows) == len(orows)
    assert _digest(rows, df.columns) == _digest(orows, ocols)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "similarity_score" in df.columns
