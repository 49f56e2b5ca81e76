"""The registered queries on the smallest tables."""

from __future__ import annotations

import pytest

from vecframe.llm import queries as Q

COLUMNS = {
    "p1_found": ["id", "group_id"], "p2_found": ["id"], "p3_found": ["id_a", "id_b"], "p4_found": ["id", "field_name"], "p5_found": ["id", "cluster_id"],
    "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p6_ids", "p8_found"])
def test_columns(spark, data, name):
    df = Q.queries()[name](spark, data)
    assert df.columns == COLUMNS[name] and df.count() > 0


def test_every_problem_has_a_query():
    assert {n.split("_")[0] for n in Q.queries()} == {f"p{i}" for i in range(1, 9)}
    assert set(COLUMNS) <= set(Q.queries()) and set(Q.oracle_sql()) <= set(Q.queries())


def test_oversized_against_sql(spark, data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("doc_entities", "split_limits"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = {int(r) for r in con.execute(Q.oracle_sql()["p2_found"]).fetchdf()["id"]}
    assert {r.id for r in Q.queries()["p2_found"](spark, data).collect()} == want
