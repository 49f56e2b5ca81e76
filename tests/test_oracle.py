"""Every query with a SQL twin against it, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from vecframe.plans import catalogue

duckdb = pytest.importorskip("duckdb")


def _norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_twin(spark, data, db, name):
    df = catalogue.queries()[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    frame = db.execute(catalogue.oracle_sql()[name]).fetchdf()
    want = list(frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))
    assert sorted(df.columns) == sorted(frame.columns)
    assert _norm(got, df.columns) == _norm(want, list(frame.columns))
