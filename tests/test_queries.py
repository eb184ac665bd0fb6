"""Every registered query of the library against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from scribespark.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) if not isinstance(x, bool) else x


def _rows(rows, columns, names):
    at = [names.index(c) for c in columns]
    return sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows or name in ("browse_filter",)
    if name in ORACLES:
        got = db.execute(ORACLES[name])
        names = [d[0] for d in got.description]
        columns = sorted(df.columns)
        assert sorted(names) == columns
        assert _rows(rows, columns, df.columns) == _rows(got.fetchall(), columns, names)
