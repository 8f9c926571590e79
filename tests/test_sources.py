import json

import pytest
from corpus import base, fill

from tidemark.library import REGISTRY, install
from tidemark.sources import code, frontmatter, markdown, schema, store
from tidemark.streaming.deltas import Versions, follow

FILES = {
    "docs/plan.md": "---\nstatus: draft\ndate: 2026-01-02\ndepends-on: [spec-v2.md, OQ-1]\nowner: me\n---\n# The plan\n\nBuilds on OQ-2 and OQ-3. See [other](other.md#x).\n\n## Next steps\nsrc/main.rs:10-20 and §4.2\n",
    "docs/other.md": "# Other\nSee OQ-1 and docs/plan.md\n```\nOQ-9\n```\n",
    "docs/spec-v1.md": "Nothing here.\n",
    "docs/spec-v2.md": "---\nupdated: 2026-03-01\nsupersedes:\n  - spec-v1.md\n---\n# OQ-3 stays open\nmissing.md\n",
    "notes/2026-02-03-log.md": "XY-1 only\n",
}


@pytest.fixture()
def extracted(spark, engine):
    files = spark.createDataFrame(list(FILES.items()), "path string, text string")
    return markdown.extract(files, written=engine.written, corpus="c", concerns={"docs": ["docs/*"], "one": ["OQ-1"]})


def pairs(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_markdown_handles(extracted):
    h = {r.id: r for r in extracted["handle"].collect()}
    assert {i for i, r in h.items() if r.kind == "label"} == {"OQ-1", "OQ-2", "OQ-3"}  # XY has one number
    assert h["docs/plan.md"].status == "draft" and h["docs/plan.md"].date == "2026-01-02" and h["docs/plan.md"].summary == "The plan"
    assert h["notes/2026-02-03-log.md"].date == "2026-02-03" and h["docs/spec-v2.md"].date == "2026-03-01"
    assert h["OQ-3"].file == "docs/spec-v2.md" and h["docs/plan.md"].area == "docs"
    assert h["src/main.rs:10"].kind == "external" and h["spec-v2"].kind == "version"


def test_markdown_edges(extracted):
    e = pairs(extracted["edge"], "from", "to", "kind")
    assert ("docs/plan.md", "docs/spec-v2.md", "DependsOn") in e and ("docs/plan.md", "OQ-1", "DependsOn") in e
    assert ("docs/plan.md", "OQ-2", "DependsOn") in e and ("docs/other.md", "OQ-1", "Cites") in e
    assert ("docs/plan.md", "docs/other.md", "Cites") in e and ("docs/plan.md", "docs/other.md", "DependsOn") not in e
    assert ("docs/spec-v1.md", "docs/spec-v2.md", "Supersedes") in e  # old to new
    assert ("spec-v2", "spec-v1", "Supersedes") in e  # new to old
    assert ("docs/plan.md", "section:4.2", "Cites") in e and ("docs/spec-v2.md", "missing.md", "Cites") in e
    assert not any(b == "OQ-9" for _, b, _ in e)


def test_front_matter():
    text = """---
status: draft (for now)
title: "A: b # c"  # said
refs: ["a, b.md", 'c.md',
  d.md]
depends-on:
- x.md (the first)
- "y.md"
nested:
  k: v
text: |
  one
  two
folded: >-
  one
  two
ok: True
none: ~
owner: me and
  you
---
body"""
    lines, taken = frontmatter.split(text.split("\n"))
    assert taken == 21 and frontmatter.split(["---", "a: b"]) == ([], 0) == frontmatter.split(["a", "---"])
    assert frontmatter.parse(lines) == {
        "status": ["draft"], "title": ["A: b # c"], "refs": ["a, b.md", "c.md", "d.md"], "depends-on": ["x.md", "y.md"], "nested": [],
        "text": ["one\ntwo"], "folded": ["one two"], "ok": ["true"], "none": [], "owner": ["me and you"],
    }


def test_blocks_of_text():
    text = "Title A-1\n=====\nbuilds on A-2\nand A-3 `src/a.rs:3` `A-9` [o](other.md#x) [[wiki|w]]\n\n- item A-4\n  more\n\nText\n\n    indented A-7\n\n~~~\nA-6\n~~~\n| a | A-10 |\n> §4.2 target/x.rs lib/../...rs http://h/src/a.rs src/B.RS\n---\n## End ##\n"
    found = {(i[0], i[1], i[3], i[4]) for i in markdown.items("p", text) if i[0] not in ("body", "heading")}
    assert found == {
        ("label", "A-1", "definition", 1), ("label", "A-2", "DependsOn", 3), ("label", "A-3", "Cites", 3), ("code", "src/a.rs", "Cites", 4), ("ref", "other.md", "Cites", 4),
        ("ref", "wiki", "Cites", 4), ("label", "A-4", "Cites", 6), ("label", "A-10", "Cites", 16), ("ref", "section:4.2", "Cites", 17), ("code", "src/B.RS", "Cites", 17),
    }
    assert [(i[1], i[4]) for i in markdown.items("p", text) if i[0] == "heading"] == [("Title A-1", 1), ("End", 19)]
    assert not [i for i in markdown.items("p", "tools/x.py") if i[0] == "code"] and [i for i in markdown.items("p", "tools/x.py", ("tools",)) if i[0] == "code"]


def test_markdown_content(extracted):
    assert ("docs/plan.md", "owner", "me", "authored_unmodeled") in pairs(extracted["meta"], "handle", "key", "value", "role")
    s = {r.id: (r.start_line, r.end_line, r.summary) for r in extracted["span"].collect()}
    assert s["docs/plan.md#h/next-steps-11"] == (11, 13, "Next steps")
    assert pairs(extracted["concern"], "name", "member") >= {("docs", "docs/plan.md"), ("one", "OQ-1")}


def test_code(spark):
    files = spark.createDataFrame([("src/a.rs", "// TODO: tidy up\nfn x() {}\n"), ("tests/b.py", "x"), ("src/gen.py", "# @generated"), ("target/c.rs", ""), ("a.txt", "")], "path string, text string")
    out = code.extract(files)
    assert pairs(out["handle"], "id", "status") == {("src/a.rs", "public"), ("tests/b.py", "test"), ("src/gen.py", "generated")}
    assert ("src/a.rs", "code.note.todo", "1: tidy up") in pairs(out["meta"], "handle", "key", "value")


def test_batches(spark):
    rows = lambda *ids: schema.rows(spark, "handle", [base(id=i, native_id=i, kind="file") for i in ids])
    r = store.merge({}, {"handle": rows("a", "b")}, "c", "s")
    r = store.merge(r, {"handle": rows("x")}, "c", "other")
    r = store.merge(r, {"handle": rows("b", "d")}, "c", "s", delta=True, retracted=spark.createDataFrame([("a",)], "native_id string"))
    assert pairs(r["handle"], "id", "source") == {("b", "s"), ("d", "s"), ("x", "other")}
    assert pairs(r["generation"], "source", "current") == {("s", 2), ("other", 1)}
    r2 = store.merge(r, {"handle": rows("z")}, "c", "s")
    assert pairs(r2["handle"], "id") == {("z",), ("x",)}
    with pytest.raises(store.DuplicateHandle):
        store.merge(r, {"handle": rows("x")}, "c", "s")


def test_history(spark, engine, tmp_path):
    fill(engine)
    none = spark.createDataFrame([], schema.schema("snapshot"))
    one = store.take_snapshot(engine.relation("handle"), none, "s1", "2026-01-01")
    assert store.take_snapshot(engine.relation("handle"), one, "s2", "2026-01-02") is one
    store.write_history(one, f"{tmp_path}/h")
    with open(f"{tmp_path}/h/part-bad.json", "w") as f:
        f.write("{broken\n" + json.dumps({"id": "x"}) + "\n")
    good, bad = store.read_history(spark, f"{tmp_path}/h")
    assert good.exceptAll(one).isEmpty() and bad.count() == 2
    store.write_rows(good.limit(3), f"{tmp_path}/rows")
    assert spark.read.text(f"{tmp_path}/rows").count() == 3


def test_stream_of_changes(spark, tmp_path):
    kinds = "op string, seq long, corpus string, source string, native_id string, id string, status string"
    put = lambda name, *rows: spark.createDataFrame(list(rows), kinds).coalesce(1).write.json(f"{tmp_path}/in/{name}")
    v = Versions(spark, f"{tmp_path}/out", "handle")
    changes = lambda: spark.readStream.schema(kinds).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
    put("a", ("upsert", 1, "c", "s", "h1", "h1", "draft"), ("upsert", 2, "c", "s", "h1", "h1", "done"), ("upsert", 1, "c", "s", "h2", "h2", None))
    follow(changes(), v, f"{tmp_path}/cp").awaitTermination(120)
    assert pairs(v.read(), "id", "status") == {("h1", "done"), ("h2", None)}
    put("b", ("retract", 3, "c", "s", "h2", "h2", None))
    follow(changes(), v, f"{tmp_path}/cp").awaitTermination(120)
    assert pairs(v.read(), "id") == {("h1",)}
    assert not v.apply(spark.createDataFrame([], kinds), v.latest())


def test_library(engine):
    fill(engine)
    install(engine)
    engine.load('config convergence { ordering(["raw", "draft", "research", "current"]). terminal(["resolved"]). } config handles { linear(["OQ"]). }')
    assert {r.h for r in engine.query('? diagnostic("E002", s, h, f, l, e).').collect()} == {"OQ-22", "OQ-23", "OQ-60", "OQ-88"}
    assert engine.query('? diagnostic("W001", s, h, f, l, e).').count() == 1
    assert ("OQ-23", 6) in {(r.h, r.n) for r in engine.query("? potential(h, n).").collect()}
    assert {r.d for r in engine.query('? currency_disposition("formal-model/v16.md", d).').collect()} == {"superseded"}
    assert engine.query("? axis_of(p, a).").count() == len(REGISTRY)
    with pytest.raises(Exception, match="primitive|protected"):
        engine.load('diagnostic("X", "error", "a", null, null, null).')
    # Rules that replace a predicate replace it in the library's own plans too.
    engine.load('potential_weight("undischarged", 100).')
    assert ("OQ-23", 100) in {(r.h, r.n) for r in engine.query("? potential(h, n).").collect()}


def test_verbs(engine):
    fill(engine)
    install(engine)
    assert engine.verb("handle", id="OQ-22").count() == 4
    assert engine.verb("search", query="jit stale", limit=3).select("h").first().h == "compiler/jit-stale.md"
    assert engine.verb("check").count() == 0
    assert engine.verb("describe", name="hub").count() == 1
    with pytest.raises(TypeError):
        engine.verb("read")
