"""What one task holds and what plans read, for steps that grew with the input."""

import math
import re

import pytest
from corpus import fill

from tidemark.library import install, orientation, topic
from tidemark.library.base import Library
from tidemark.operators import search
from tidemark.sources import schema, store


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture()
def library(engine):
    install(fill(engine))
    return engine


def test_dispositions_are_one_grouping(library):
    found = library.query("? hit_currency_disposition(h, d).")
    assert optimized(found).count("Join") <= 1
    of = {r.h: r.d for r in found.collect()}
    assert of["formal-model/v17.md"] == of["formal-model/v16.md"] == of["formal-model/v15.md"] == "superseded"
    assert of["formal-model/v14.md"] == "current_head" and of["compiler/exec.md"] == "current" and of["OQ-22"] == "unknown"
    assert found.count() == len(of) == 15


def test_pairs_are_made_of_a_written_table(library):
    assert optimized(topic.topic_shared_target(Library(library))).count("Join") == 1


def test_candidates_hold_few_joins(library):
    assert optimized(orientation.recent_frontier_candidate(Library(library))).count("Join") <= 10


def test_bands_and_boosts(engine):
    row = lambda i, **k: {"corpus": "c", "source": "s", "native_id": i, "id": i, "kind": "file", "file": i, "line": 1, "area": "", "namespace": "", "summary": ""} | k
    engine.facts("handle", [row("a"), row("b"), row("c"), row("d"), row("e", date="2026-05-01"), row("g/README.md", status="draft"), row("x", status="closed"), row("l", kind="label", file="x")])
    day = {"a": "2026-05-05", "b": "2026-04-20", "c": "2026-03-01", "d": "2025-06-01", "e": "2026-05-05", "x": "2020-01-01"}
    engine.facts("git_mtimes", [{"file": f, "instant": f"{at}T12:00:00Z"} for f, at in day.items()])
    install(engine)
    rows = lambda q: {tuple(r) for r in engine.query(q).collect()}
    assert rows("? changed_recently(h, i).") == {("a", "7d"), ("b", "30d"), ("c", "90d"), ("d", "365d")}
    assert rows("? recent_active_boost(h, i).") == {("g/README.md", 200)} | {(h, 0) for h in "abcdex"}
    assert rows("? recent_curated_penalty(h, i).") == {("g/README.md", 5000)} | {(h, 0) for h in "abcdex"}


def test_summaries_are_hashed_where_they_lie(spark, engine):
    data = [("a", 3, 1.5), ("a", None, math.nan), ("b", 7, 2.0), ("b", 5, None), (None, 9, -1.0)]
    engine.register("t", spark.createDataFrame(data, "k string, n long, x double"))
    engine.register("u", spark.createDataFrame([("a",), (None,)], "k string"))
    found = engine.query("? *u{k: k}, lo = Min{ n : *t{k: k, n: n} }, hi = Max{ n : *t{k: k, n: n} }, most = Max{ x : *t{k: k, x: x} }, m = Count{ n : *t{k: k, n: n} }.")
    rows = {r.k: (r.hi, r.lo, r.m, r.most) for r in found.collect()}
    assert rows["a"][:3] == (3, None, 2) and math.isnan(rows["a"][3]) and rows[None] == (9, 9, 1, -1.0) and len(rows) == 2
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    # One join for each summary: their rows are grouped before it.
    assert optimized(found).count("Join") == 4
    # Keys of another kind equal nothing.
    engine.register("w", spark.createDataFrame([(3,), (9,)], "n long"))
    engine.register("y", spark.createDataFrame([(3.0, 1)], "f double, v long"))
    assert [(r.n, r.m) for r in engine.query("? *w{n: n}, m = Count{ v : *y{f: n, v: v} }, n > 5.").collect()] == [(9, 0)]


def test_snapshots_are_dealt_by_their_rows(spark, engine, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 100)
    row = lambda i, s: {"corpus": "c", "source": "s", "native_id": str(i), "id": str(i), "kind": "file", "status": s}
    engine.facts("handle", [row(i, "draft") for i in range(300)] + [row(7, "draft")])
    handle, none = engine.relation("handle"), spark.createDataFrame([], schema.schema("snapshot"))
    one = engine.written(store.take_snapshot(handle, none, "s1", "2026-01-01"))
    assert one.count() == len({(r.id, r.key, r.value) for r in one.collect()}) == 600
    assert store.take_snapshot(handle, one, "s1b", "2026-01-02") is one
    engine.facts("handle", [row(i, "draft" if i else "done") for i in range(300)])
    two = store.take_snapshot(engine.relation("handle"), one, "s2", "2026-01-03")
    assert two.count() == 1200
    assert re.search(r"hashpartitioning\(corpus#\d+, id#\d+, 22\), REPARTITION_BY_NUM", two._jdf.queryExecution().executedPlan().toString())
    # A row that went is a change as well.
    assert store.take_snapshot(engine.relation("handle").where("id <> '9'"), two, "s3", "2026-01-04").count() == 1200 + 598


def test_texts_are_scored_once(engine):
    fill(engine)
    assert "contains(text" not in optimized(search.ranked(engine, ["jit spec", "open question"])).lower()


def test_no_writing_task_holds_many_partitions(spark, engine):
    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        assert len(engine.written(spark.range(4000).groupBy("id").count()).inputFiles()) == 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
