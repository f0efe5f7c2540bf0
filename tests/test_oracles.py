"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from textmill.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, str(DATA))
    columns = sorted(frame.columns)
    ours = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in frame.collect())
    found = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    theirs = sorted(repr(tuple(_plain(dict(zip(names, r, strict=True))[c]) for c in columns)) for r in found.fetchall())
    assert sorted(names) == columns
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, str(DATA)).count() > 0
