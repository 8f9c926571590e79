"""Queries of sources, search, introspection and sinks against the SQL that states their rows."""

import os

import duckdb
import pytest

from tidemark import feature_queries

TABLES = "/root/testdata/sf0.001"
SLOW = {n for n in feature_queries.QUERIES if n.startswith("verb_")} - {"verb_rows", "verb_with_default"}


def plain(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        at = f"{TABLES}/{f}" + ("/*.parquet" if os.path.isdir(f"{TABLES}/{f}") else "")
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{at}'")
    return con


@pytest.mark.parametrize("name", [n for n in feature_queries.QUERIES if n not in SLOW])
def test_query_equals_its_sql(spark, tables, name):
    found = feature_queries.QUERIES[name](spark, TABLES)
    columns = sorted(found.columns)
    want = tables.sql(feature_queries.SQL[name])
    assert columns == sorted(want.columns)
    assert plain(found.select(*columns).collect()) == plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_budget_over_many_partitions(spark, engine):
    engine.register("cost", spark.range(2000).selectExpr("id % 500 AS k", "id", "CASE WHEN id % 7 = 0 THEN 0 ELSE id % 11 END AS c"))
    rows = sorted(((i % 500, i, 0 if i % 7 == 0 else i % 11) for i in range(2000)))
    for budget in (0, 777, 10**6):
        total, want = 0, set()
        for _, i, c in rows:
            total += c
            if total <= budget:
                want.add(i)
        found = engine.query(f"? i = TakeUntil{{ budget: {budget}, sum: c, key: (k, i) : i : *cost{{k: k, id: i, c: c}} }}.")
        assert {r.i for r in found.collect()} == want


def test_more_searches_than_one_block_holds(engine, monkeypatch):
    from corpus import fill

    from tidemark.operators import search

    fill(engine)
    text = "".join(f'ask("{w}"). ' for w in ("jit", "exec", "discharge", "model", "draft")) + "? ask(q), search(q, h, span, s, why, f, low)."
    whole = plain(engine.query(text).collect())
    monkeypatch.setattr(search, "BLOCK", 2)
    assert plain(engine.query(text).collect()) == whole and len({r[3] for r in whole}) > 1
