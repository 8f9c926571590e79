import random

import pytest
from corpus import RULES, base, fill, v
from pyspark.sql import types as T

from tidemark.functions.values import ValueProblem
from tidemark.operators.history import NoSnapshot
from tidemark.plans.compiler import RuleProblem
from tidemark.plans.syntax import SyntaxProblem, parse


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def small(engine):
    fill(engine).load(RULES)
    return engine


def test_open_questions_and_counts(small):
    assert rows(small.query("? open_oq(q).")) == [(f"OQ-{n}",) for n in (22, 23, 60, 77, 88)]
    assert rows(small.query("? pressure(q, n).")) == [(1, "OQ-22"), (1, "OQ-23"), (1, "OQ-60"), (0, "OQ-77"), (0, "OQ-88")] or sorted(map(tuple, small.query("? pressure(q, n).").select("q", "n").collect())) == [("OQ-22", 1), ("OQ-23", 1), ("OQ-60", 1), ("OQ-77", 0), ("OQ-88", 0)]
    assert rows(small.query("? in_area(a, n).")) == [("compiler", 2), ("formal-model", 2), ("research-log", 1)]


def test_recursion(small):
    found = small.query(f'? succession("{v(17)}", t, d).').select("t", "d")
    assert rows(found) == [(v(14), 3), (v(15), 2), (v(16), 1)]


def test_clauses_of_different_shapes(small):
    found = {(r.h, r.why, r.file, r.line, r.t) for r in small.query("? blocker(h, why, file, line, t).").collect()}
    assert found == {("compiler/jit-spec.md", "broken_ref", "compiler/jit-spec.md", 51, None), ("compiler/jit-spec.md", "stale_dep", None, None, "compiler/jit-stale.md")} | {(f"OQ-{n}", "undischarged", None, None, None) for n in (22, 23, 60, 88)}


def test_graph_primitives(engine):
    fill(engine)
    assert rows(engine.query(f'? upstream("{v(17)}", a).')) == [("OQ-22",), ("OQ-23",), ("OQ-60",), (v(14),), (v(15),), (v(16),)]
    assert rows(engine.query('? downstream("OQ-22", d).')) == [("compiler/exec.md",), ("compiler/jit-spec.md",), (v(17),), ("research-log/2026-04-jit.md",)]
    assert rows(engine.query('? impact("OQ-22", x, d).')) == [(1, "compiler/jit-spec.md"), (1, v(17)), (2, "compiler/exec.md")]
    assert rows(engine.query('? neighborhood("OQ-22", d, m), d <= 1.')) == [(0, "OQ-22"), (1, "compiler/jit-spec.md"), (1, v(17))]
    assert rows(engine.query('? neighborhood("OQ-22", 1, m).')) == [("compiler/jit-spec.md",), (v(17),)]
    assert rows(engine.query('? in_degree("OQ-22", n).')) == [(3,)]
    assert rows(engine.query(f'? out_degree("{v(17)}", n).')) == [(4,)]
    assert rows(engine.query(f'? cite_count("{v(17)}", n).')) == [(1,)]
    assert rows(engine.query(f'? upstream(h, "{v(14)}").')) == [(v(15),), (v(16),), (v(17),), ("research-log/2026-04-jit.md",)]
    with pytest.raises(RuleProblem):
        engine.query("? upstream(h, a).")


def plain_reach(edges, root, most=None):
    depth, todo = {root: 0}, [root]
    for node in todo:
        for a, b in edges:
            if a == node and b not in depth and (most is None or depth[node] < most):
                depth[b] = depth[node] + 1
                todo.append(b)
    return {(root, n, d) for n, d in depth.items() if d}


@pytest.mark.parametrize("spread", [1, 8])
def test_reach_of_deep_graphs(engine, spark, monkeypatch, spread):
    """Chains with side branches, a cycle, a dense part and parallel paths of different lengths."""
    from tidemark.operators import graph

    monkeypatch.setattr(graph, "SPREAD", spread)
    rng = random.Random(spread)
    edges = [(f"a{i}", f"a{i + 1}") for i in range(70)] + [(f"a{i}", f"b{i}") for i in range(0, 70, 3)] + [(f"c{i}", f"c{(i + 1) % 23}") for i in range(23)]
    edges += [("a69", "c4"), ("a10", "a40"), ("c9", "a5"), ("x", "x")] + [(f"d{rng.randrange(12)}", f"d{rng.randrange(12)}") for _ in range(70)] + [("a30", "d1"), ("d2", "e0")] + [(f"e{i}", f"e{i + 1}") for i in range(40)]
    e = spark.createDataFrame(edges, "src string, dst string")
    roots = spark.createDataFrame([("a0",), ("c0",), ("x",), ("nowhere",), (None,), ("a0",)], "root string")
    for most in (None, 0, 2, 4, 9, 33):
        got = {tuple(r) for r in graph.reach(engine, roots, e, most).collect()}
        assert got == set().union(*(plain_reach(edges, r, most) for r in ("a0", "c0", "x", "nowhere")))


def test_depth_is_bounded_by_the_body(engine, monkeypatch):
    from tidemark.operators import graph

    fill(engine)
    asked = []
    real = graph.reach
    monkeypatch.setattr(graph, "reach", lambda ctx, seeds, edges, most=None: asked.append(most) or real(ctx, seeds, edges, most))
    for text, most in (("d <= 1", 1), ("d < 2", 1), ("2 > d", 1), ("d = 1", 1), ("d >= 1", None), ("d < 2, d <= 3", 1)):
        engine.query(f'? neighborhood("OQ-22", d, m), {text}.').collect()
        assert asked.pop() == most
    assert rows(engine.query('? impact("OQ-22", x, 1).')) == [("compiler/jit-spec.md",), (v(17),)] and asked.pop() == 1


def test_long_chain(engine):
    engine.facts("edge", [{"from": f"n{i}", "to": f"n{i + 1}", "kind": "Cites"} for i in range(4096)])
    assert engine.query('? upstream("n0", a).').count() == 4096
    assert engine.query('? impact("n9", x, d).').count() == 0


@pytest.mark.parametrize("text", ["r(x, z) := r(x, p), *edge{from: p, to: z, kind: \"Cites\"}.", "r(x, z) := *edge{from: x, to: p, kind: \"Cites\"}, r(p, z).", "r(x, z) := *edge{from: p, to: z, kind: \"Cites\"}, r(x, p)."])
def test_closures_take_few_rounds(engine, monkeypatch, text):
    engine.facts("edge", [{"from": f"n{i:02}", "to": f"n{i + 1:02}", "kind": "Cites"} for i in range(60)] + [{"from": "n60", "to": "n58", "kind": "Cites"}, {"from": "n60", "to": "z", "kind": "Other"}])
    writes = []
    real = engine.written
    monkeypatch.setattr(engine, "written", lambda df: writes.append(1) or real(df))
    got = rows(engine.query(f'r(a, b) := *edge{{from: a, to: b, kind: "Cites"}}. {text} ? r(x, y).'))
    edges = [(f"n{i:02}", f"n{i + 1:02}") for i in range(60)] + [("n60", "n58")]
    want = {(a, n) for a in {a for a, _ in edges} for _, n, _ in plain_reach(edges, a)} | {(f"n{i}", f"n{i}") for i in (58, 59, 60)}
    assert set(got) == want and len(writes) <= 12


def test_recursion_that_is_no_closure_is_left_alone(engine):
    engine.load('link("a", "b", 1). link("b", "c", 2). link("c", "d", 1). r(x, y) := link(x, y, w). r(x, z) := r(x, y), link(y, z, 1). back(x, y) := link(x, y, w). back(x, z) := back(x, y), link(z, y, w).')
    assert rows(engine.query("? r(x, y).")) == [("a", "b"), ("b", "c"), ("b", "d"), ("c", "d")]
    assert rows(engine.query("? back(x, y).")) == [("a", "a"), ("a", "b")] + [("b", x) for x in "abc"] + [("c", x) for x in "abcd"]


AMOUNTS = 'amount("a", 2). amount("b", 2). amount("c", 5). '


def test_scalar_aggregates(engine):
    for fn, want in (("Sum", 9), ("Count", 2), ("Min", 2), ("Max", 5), ("Avg", 3.0), ("List", [2, 5]), ("Set", [2, 5])):
        assert engine.query(f"{AMOUNTS} ? r = {fn}{{ x : amount(i, x) }}.").collect()[0].r == want


def test_empty_groups(engine):
    text = 'g("a"). e("b", 1). '
    assert rows(engine.query(text + "? g(g), n = Count{ x : e(g, x) }.")) == [("a", 0)]
    assert rows(engine.query(text + "? g(g), n = Sum{ x : e(g, x) }.")) == []
    assert rows(engine.query(text + "? g(g), 0 = Count{ x : e(g, x) }.")) == [("a",)]


def test_selections(engine):
    text = 'score("a", 5). score("b", 9). score("c", 9). score("d", 2). '
    assert rows(engine.query(text + "? (h, s) = TopK{ k: 2, key: s : (h, s) : score(h, s) }.")) == [("b", 9), ("c", 9)]
    assert rows(engine.query(text + "? (h, r) = Rank{ key: s, rank: r : (h, r) : score(h, s) }.")) == [("a", 2), ("b", 1), ("c", 1), ("d", 3)]
    spans = 'span("s1", 1, 3). span("s2", 2, 4). span("s3", 3, 2). '
    assert rows(engine.query(spans + "? (i, n) = TakeUntil{ budget: 7, sum: n, key: line : (i, n) : span(i, line, n) }.")) == [("s1", 3), ("s2", 4)]
    with pytest.raises(Exception, match="negative"):
        engine.query(spans + "? (i, n) = TakeUntil{ budget: 9, sum: 0 - n, key: line : (i, n) : span(i, line, n) }.").collect()
    with pytest.raises(RuleProblem):
        engine.query(text + "? (h, s) = TopK{ k: 1 : (h, s) : score(h, s) }.")


def test_null_and_kinds(engine):
    text = 'p("a", null). p("b", "x"). q(null). q("x"). '
    assert rows(engine.query(text + "? p(k, v), q(v).")) == [("a", None), ("b", "x")]
    assert rows(engine.query("n(1). f(1.0). ? n(x), f(y), x = y.")) == []
    assert rows(engine.query("n(2). f(1.0). ? n(x), f(y), x < y.")) == [(2, 1.0)]
    assert rows(engine.query(text + "? p(k, v), not q(v).")) == []
    assert rows(engine.query("? x = -7 / 2, y = -7 % 2, z = 7.0 / 2.")) == [(-3, -1, 3.5)]
    with pytest.raises(ValueProblem):
        engine.query('? x = "a" + 1.')


def test_bags_and_sets(engine, spark):
    engine.register("t", spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "n int, s string"))
    assert engine.query("? *t{n}.").count() == 3
    assert engine.query("p(n) := *t{n}. ? p(n).").count() == 2
    assert rows(engine.query("? s = Sum{ n : *t{n} }.")) == [(4,)]
    assert engine.query("? *t{n: 1}.").count() == 2
    assert isinstance(engine.query("? *t{n}.").schema["n"].dataType, T.LongType)


def test_terms_in_atoms(engine):
    text = "e(1, 2). e(2, 3). e(3, 3). e(5, 7). "
    assert rows(engine.query(text + "? e(x, x).")) == [(3,)]
    assert rows(engine.query(text + "? e(x, x + 1).")) == [(1,), (2,)]
    assert rows(engine.query(text + "? y = x + 1, e(x, y).")) == [(1, 2), (2, 3)]
    assert rows(engine.query(text + '? e(x, _), x in [1, 5], t = (x, "k"), (a, b) = t.').select("x", "a", "b")) == [(1, 1, "k"), (5, 5, "k")]


def test_order_and_named_calls(engine):
    text = "r(a, b) := e(a, b). e(1, 9). e(2, 8). e(3, 7). "
    assert [r.b for r in engine.query(text + "? r(a, b) order by b.").collect()] == [7, 8, 9]
    assert [r.a for r in engine.query(text + "? r(a, b) order by a % 2 desc, a.").collect()] == [1, 3, 2]
    assert rows(engine.query(text + "? r{b: 8, a: x}.")) == [(2,)]
    assert rows(engine.query(text + "? r(b: y, a: 3).")) == [(7,)]
    with pytest.raises(RuleProblem):
        engine.query(text + "? r(c: y, a: 3).")


def test_local_rules(engine):
    assert rows(engine.query("p(1). p(2). ? where q(x) := p(x), x > 1. q(x).")) == [(2,)]


def test_static_errors(engine):
    for text in ("p(x) := q(x), not p(x). q(1). ? p(x).", "p(x, y) := q(x). q(1). ? p(x, y).", "q(1). ? not q(y).", "? nothing(x).", "a(n) := n = Count{ x : a(x) }. a(1). ? a(n).", "p(1). p(n + 1) := p(n). ? p(n).", "? *handle{nofield: x}."):
        with pytest.raises((RuleProblem, ValueProblem)):
            engine.query(text).collect()
    for text in ("? foo(h), order by h.", "? P(x).", 'p("a).', "? n = 9223372036854775808."):
        with pytest.raises(SyntaxProblem):
            parse(text)


def test_mutual_recursion(engine):
    text = "next(0, 1). next(1, 2). next(2, 3). next(3, 4). even(0). even(y) := odd(x), next(x, y). odd(y) := even(x), next(x, y). "
    with pytest.raises(RuleProblem):
        engine.query(text + "? odd(x).")  # odd has no clause to start from
    text += "odd(1). "
    assert rows(engine.query(text + "? odd(x).")) == [(1,), (3,)]
    cycle = 'e("a", "b"). e("b", "c"). e("c", "a"). t(x, y) := e(x, y). t(x, z) := t(x, y), t(y, z). '
    assert engine.query(cycle + "? t(x, y).").count() == 9


def timed(engine):
    fill(engine)
    engine.facts("handle", [base(id="draft.md", kind="file", status="current", namespace="", file="draft.md", line=1, date="2026-05-01", area="", summary=""), base(id="plan.md", kind="file", status="plan", namespace="", file="plan.md", line=1, area="", summary="")])
    engine.facts("snapshot", [dict(corpus="test", snapshot="s1", at="2026-05-01", id="draft.md", key="status", value="raw"), dict(corpus="test", snapshot="s2", at="2026-05-05", id="draft.md", key="status", value="draft"), dict(corpus="test", snapshot="s2", at="2026-05-05", id="ghost.md", key="status", value="x")])
    return engine


def test_time_blocks(engine):
    timed(engine)
    at = lambda ref: rows(engine.query(f'? at("{ref}") {{ *handle{{id: "draft.md", status: s}} }}.'))
    assert at("snapshot:last") == at("snapshot:s2") == at("2026-05-04") == at("--1days") == [("draft",)]
    assert at("snapshot:s1") == at("2026-04-01") == [("raw",)]
    assert at("2026-05-03") == [("draft",)]  # as near as s1, and later
    assert rows(engine.query('? at("snapshot:last") { *handle{id: h, status: s} }.')) == [("draft.md", "draft"), ("plan.md", "plan")]
    with pytest.raises(NoSnapshot):
        at("snapshot:nope")
    with pytest.raises(RuleProblem):
        engine.query('? at("snapshot:last") { *edge{from: f} }.')
    assert any("partial_history" in w for w in engine.warnings)


def test_recency(engine):
    timed(engine)
    assert rows(engine.query("? freshness(h, n).")) == [("draft.md", 6), ("plan.md", 0)]
    assert rows(engine.query('? flux("draft.md", 20, n).')) == [(2,)]
    assert rows(engine.query('? flux("draft.md", 3, n).')) == [(1,)]
    engine.facts("git_mtimes", [dict(file="plan.md", instant="2026-05-06T10:00:00Z")])
    assert rows(engine.query("? changed_within(h, 2).")) == [("plan.md",)]
    assert rows(engine.query("? changed_within(h, 0).")) == []


def test_lifecycle(engine):
    fill(engine)
    assert ("OQ-99",) in rows(engine.query("? terminal(h)."))
    engine.load('config convergence { ordering(["raw", "draft", "current"]). terminal(["draft"]). settled(["open"]). } config handles { linear(["OQ"]). }')
    assert rows(engine.query('? terminal("compiler/jit-spec.md").')) == [()]
    assert rows(engine.query('? pipeline_position("compiler/exec.md", n).')) == [(2,)]
    assert rows(engine.query("? settled(h).")) == [(f"OQ-{n}",) for n in (22, 23, 60, 77, 88)]
    assert rows(engine.query("? undischarged(h).")) == [(f"OQ-{n}",) for n in (22, 23, 60, 88)]
    assert ("terminal", "project", "draft") in rows(engine.query("? lifecycle_status_classification(s, c, o)."))


def test_content(engine):
    c = lambda h, s, n, text: base(handle=h, span_id=s, lines=1, text=text, tokens=n)
    engine.facts("content", [c("a.md", "a1", 4, "one two"), c("a.md", "a2", 5, "three\nfour"), c("a.md", "a3", 8, "five"), c("b.md", "b1", 20, "abcdefghijklmnopqrstuvwxyz")])
    engine.facts("span", [base(id=s, handle="a.md", start_line=n, end_line=n, summary="") for s, n in (("a1", 1), ("a2", 10), ("a3", 30))])
    assert rows(engine.query('? read("a.md", 9, s, t, b, e, n).').select("s")) == [("a1",), ("a2",)]
    assert rows(engine.query('? read("b.md", 3, s, t, b, e, n).').select("t")) == [("abcdefghijkl\n...",)]
    assert rows(engine.query('? read_full("a.md", t).')) == [("one two\nthree\nfour\nfive",)]
    assert rows(engine.query('? *content{handle: h}, match("^f", h, line, text).').distinct()) == [("a.md", 11, "four"), ("a.md", 30, "five")]


def test_search(engine):
    engine.facts("handle", [base(id=i, kind="file", status=s, file=i, summary=t, line=1, namespace="", area="x") for i, s, t in (("specs/jit.md", "current", "Compilation of hot loops"), ("specs/old.md", "superseded", "Loops before"), ("notes/other.md", "draft", "Nothing"))])
    engine.facts("content", [base(handle="notes/other.md", span_id="notes/other.md#full", text="we compile loops", tokens=3, lines=1)])
    found = engine.query('? search("hot loops", h, span, score, why, field, low).').orderBy("score", ascending=False).collect()
    assert found[0].h == "specs/jit.md" and found[0].field == "title" and not found[0].low
    assert {r.h for r in found} == {"specs/jit.md", "specs/old.md", "notes/other.md"}
    with pytest.raises(ValueError):
        engine.query('? search("--", h, span, score, why, field, low).')


def test_stemming_agrees(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import search as S

    words = "running planned stories compilation measures cats us glass structure exploration tested ied sing".split()
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(S.stem_column(F.col("w"))).collect()]
    assert got == [S.stem(w) for w in words]


def test_layers_verbs_and_introspection(engine):
    engine.load('@doc(name: "p", text: "numbers"). @predicate(name: "q", args: "x", shadow: "forbid"). p(1). q(1). @verb(name: "above", args: "least: Int = 1", query: "? p(x), verb_arg(name, least), x >= least.").', "base.dl", "base")
    engine.load("p(2). p(3).", "own.dl")
    assert rows(engine.query("? p(x).")) == [(2,), (3,)]
    with pytest.raises(RuleProblem):
        engine.load("q(2).")
    with pytest.raises(RuleProblem):
        engine.load("upstream(a, b) := p(a), p(b).")
    assert rows(engine.verb("above", least=3).select("x")) == [(3,)]
    assert rows(engine.query('? predicates("p", doc, file, lines).')) == [("numbers", "own.dl", "1,1")]
    assert engine.query("? schema(n, k, s, d, p).").count() > 40


def test_hidden_facts(engine, spark):
    fill(engine)
    seen = engine.hide(spark.createDataFrame([("test", "fixture", "OQ-22")], "corpus string, source string, native_id string"))
    assert rows(seen.query('? *handle{id: "OQ-22", kind}.')) == []


def test_against_plain_evaluation(engine):
    """Random joins, negation and counts against loops over the same facts."""
    import random

    rng = random.Random(5)
    for _ in range(3):
        e = {(rng.randrange(6), rng.randrange(6)) for _ in range(9)}
        f = {(rng.randrange(6),) for _ in range(3)}
        text = "".join(f"e({a}, {b}). " for a, b in e) + "".join(f"f({a}). " for (a,) in f)
        got = rows(engine.query(text + "? e(x, y), e(y, z), not f(z), n = Count{ w : e(z, w), w != x }."))
        want = sorted(((len({w for zz, w in e if zz == z and w != x}), x, y, z) for x, y in e for yy, z in e if yy == y and (z,) not in f), key=repr)
        assert got == want


def test_large_ids_are_not_broadcast(spark, engine):
    # 200,000 ids: less than 2 MB of files, and some 20 MB in memory.
    ids = lambda name: engine.register(name, engine.written(spark.range(200_000).selectExpr("concat('doc/', id, '.md') AS k")))
    ids("one"), ids("two")
    engine.register("few", spark.range(5).selectExpr("concat('doc/', id, '.md') AS k"))
    joined = lambda a, b: engine.query(f"? *{a}{{k: k}}, *{b}{{k: k}}.")
    kind = lambda df: df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    both, some = joined("one", "two"), joined("one", "few")
    assert len(both.collect()) == 200_000 and "BroadcastHashJoin" not in kind(both)
    assert len(some.collect()) == 5 and "BroadcastHashJoin" in kind(some)
