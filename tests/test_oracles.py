from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from eventloom.oracles import ORACLE_SQL
from eventloom.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def table(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].copy()
    for c in cols:
        if frame[c].dtype.kind in "iub":
            frame[c] = frame[c].astype("int64")
    return frame.astype(str).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in ORACLE_SQL:
        assert table(got).equals(table(duck.execute(ORACLE_SQL[name]).df()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
