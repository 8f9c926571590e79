"""The engine's registered queries over the demonstration tables, with the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import feature_queries, library_queries
from .library import REGISTRY
from .sources.tables import EDGE, HANDLE, engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rule(name: str, text: str, sql: str | None = None, *, corpus: bool = False, library: bool = False, limit: int | None = None, corpus_sql: bool = True) -> None:
    """Registers a query in the rule language and, where it can be stated, its SQL; with corpus, h and e are put before
    it unless it has its own."""
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir, corpus=corpus, library=library).query(text, limit)
    if sql and not corpus_sql:
        SQL[name] = sql
    elif sql:
        SQL[name] = (f"WITH RECURSIVE h AS ({HANDLE}), e AS ({EDGE}), " + sql.strip().removeprefix("WITH ")) if corpus and sql.strip().startswith("WITH ") else f"WITH h AS ({HANDLE}), e AS ({EDGE}) {sql}" if corpus else sql


# Scans, filters, expressions

rule("scan_filter", '? *customer{c_custkey: k, c_mktsegment: "BUILDING", c_acctbal: b}, b > 5000.0.', "SELECT c_acctbal AS b, c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
rule("scan_bag", "? *lineitem{l_returnflag: f, l_linenumber: n}.", "SELECT l_returnflag AS f, CAST(l_linenumber AS BIGINT) AS n FROM lineitem")
rule("rule_set", "kinds(f, s) := *lineitem{l_returnflag: f, l_linestatus: s}. ? kinds(f, s).", "SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem")
rule("repeated_variable", "? *nation{n_nationkey: x, n_regionkey: x}.", "SELECT CAST(n_nationkey AS BIGINT) AS x FROM nation WHERE n_nationkey = n_regionkey")
rule("expression_term", "? *nation{n_nationkey: x, n_regionkey: x / 6, n_name: n}.", "SELECT n_name AS n, CAST(n_nationkey AS BIGINT) AS x FROM nation WHERE n_regionkey = n_nationkey // 6")
rule("membership", '? *orders{o_orderkey: k, o_orderpriority: p}, p in ["1-URGENT", "2-HIGH"].', "SELECT o_orderkey AS k, o_orderpriority AS p FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
rule("string_tests", '? *part{p_partkey: k, p_name: n, p_type: t}, n contains "o", n ends_with "t", t != "x", k <= 5000.', "SELECT p_partkey AS k, p_name AS n, p_type AS t FROM part WHERE contains(p_name, 'o') AND ends_with(p_name, 't') AND p_type <> 'x' AND p_partkey <= 5000")
rule("prefix_test", '? *events{event_id: i, event_type: t}, t starts_with "p".', "SELECT event_id AS i, event_type AS t FROM events WHERE starts_with(event_type, 'p')")
rule("arithmetic", "? *part{p_partkey: k, p_size: s}, x = s * 3 - k % 7, y = x / 4, x > 20.", "SELECT k, s, x, x // 4 AS y FROM (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s, p_size * 3 - p_partkey % 7 AS x FROM part) WHERE x > 20")
rule("tuples", "p(a, b, c) := *nation{n_nationkey: k, n_regionkey: r}, t = (r, k), (a, b) = t, a < b, c = b - a. ? p(a, b, c).", "SELECT r AS a, k AS b, k - r AS c FROM (SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS r FROM nation) WHERE r < k")

# Joins

rule("inner_join", '? *customer{c_custkey: c, c_nationkey: n}, *nation{n_nationkey: n, n_name: name, n_regionkey: r}, *region{r_regionkey: r, r_name: "ASIA"}.', "SELECT c_custkey AS c, CAST(n_nationkey AS BIGINT) AS n, n_name AS name, CAST(r_regionkey AS BIGINT) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
rule("semi_join", 'urgent(c) := *customer{c_custkey: c}, *orders{o_custkey: c, o_orderpriority: "1-URGENT"}. ? urgent(c).', "SELECT c_custkey AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
rule("anti_join", '? *customer{c_custkey: c, c_mktsegment: s}, not *orders{o_custkey: c, o_orderstatus: "P"}.', "SELECT c_custkey AS c, c_mktsegment AS s FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
rule("outer_join", 'has(c) := *orders{o_custkey: c, o_orderstatus: "P"}. out(c, "yes") := *customer{c_custkey: c}, has(c). out(c, null) := *customer{c_custkey: c}, not has(c). ? out(c, p).', "SELECT c_custkey AS c, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'yes' END AS p FROM customer")
rule("theta_join", "? *nation{n_nationkey: a, n_regionkey: r}, *nation{n_nationkey: b, n_regionkey: r}, a < b.", "SELECT CAST(x.n_nationkey AS BIGINT) AS a, CAST(y.n_nationkey AS BIGINT) AS b, CAST(x.n_regionkey AS BIGINT) AS r FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")
rule("cross_join", "? *region{r_name: a}, *region{r_name: b}, a != b.", "SELECT x.r_name AS a, y.r_name AS b FROM region x, region y WHERE x.r_name <> y.r_name")
rule("substring_join", 'tail("bolt"). tail("red "). tail("zz"). ? *part{p_name: n}, tail(t), n contains t.', "SELECT p_name AS n, t FROM part, (VALUES ('bolt'), ('red '), ('zz')) v(t) WHERE contains(p_name, t)")

# Aggregates

rule("count_zero_fill", 'seg(s) := *customer{c_mktsegment: s}. ? seg(s), n = Count{ k : *customer{c_custkey: k, c_mktsegment: s, c_acctbal: b}, b > 9990.0 }.', "SELECT c_mktsegment AS s, count(CASE WHEN c_acctbal > 9990 THEN 1 END) AS n FROM customer GROUP BY 1")
rule("count_distinct", "? n = Count{ p : *lineitem{l_partkey: p} }, m = Count{ f : *lineitem{l_returnflag: f} }.", "SELECT count(DISTINCT l_returnflag) AS m, count(DISTINCT l_partkey) AS n FROM lineitem")
rule("sum_by", "flag(f) := *lineitem{l_returnflag: f}. ? flag(f), t = Sum{ n : *lineitem{l_linenumber: n, l_returnflag: f} }.", "SELECT l_returnflag AS f, CAST(sum(l_linenumber) AS BIGINT) AS t FROM lineitem GROUP BY 1")
rule("min_max_avg", "flag(f) := *lineitem{l_returnflag: f}. ? flag(f), lo = Min{ q : *lineitem{l_extendedprice: q, l_returnflag: f} }, hi = Max{ q : *lineitem{l_extendedprice: q, l_returnflag: f} }, mid = Avg{ n : *lineitem{l_linenumber: n, l_returnflag: f} }.", "SELECT l_returnflag AS f, max(l_extendedprice) AS hi, min(l_extendedprice) AS lo, avg(l_linenumber) AS mid FROM lineitem GROUP BY 1")
rule("having", "nat(n) := *customer{c_nationkey: n}. ? nat(n), k = Count{ c : *customer{c_custkey: c, c_nationkey: n} }, k >= 60.", "SELECT count(*) AS k, CAST(c_nationkey AS BIGINT) AS n FROM customer GROUP BY 2 HAVING count(*) >= 60")
rule("nested_aggregate", "nat(n) := *customer{c_nationkey: n}. size(n, k) := nat(n), k = Count{ c : *customer{c_custkey: c, c_nationkey: n} }. ? top = Max{ k : size(n, k) }, few = Count{ n : size(n, k), k < 60 }.", "SELECT count(CASE WHEN k < 60 THEN 1 END) AS few, max(k) AS top FROM (SELECT count(*) AS k FROM customer GROUP BY c_nationkey)")
rule("set_values", "reg(r) := *region{r_regionkey: r}. member(r, n, x) := reg(r), s = Set{ k : *nation{n_nationkey: k, n_regionkey: r} }, n = Count{ k : *nation{n_nationkey: k, n_regionkey: r}, k in s }, x = Sum{ k : *nation{n_nationkey: k, n_regionkey: r} }. ? member(r, n, x).", "SELECT count(*) AS n, CAST(n_regionkey AS BIGINT) AS r, CAST(sum(n_nationkey) AS BIGINT) AS x FROM nation GROUP BY 2")
rule("top_k", "? (k, p) = TopK{ k: 10, key: p : (k, p) : *orders{o_orderkey: k, o_totalprice: p} }.", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 10")
rule("top_k_by", "nat(n) := *customer{c_nationkey: n}. ? nat(n), (c, b) = TopK{ k: 3, key: b : (c, b) : *customer{c_custkey: c, c_acctbal: b, c_nationkey: n} }.", "SELECT b, c, n FROM (SELECT c_custkey AS c, c_acctbal AS b, CAST(c_nationkey AS BIGINT) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer) WHERE i <= 3")
rule("rank_all", "? (k, r) = Rank{ key: s, rank: r : (k, r) : *part{p_partkey: k, p_size: s} }.", "SELECT p_partkey AS k, dense_rank() OVER (ORDER BY p_size DESC) AS r FROM part")
rule("rank_by", "br(b) := *part{p_brand: b}. ? br(b), (k, r) = Rank{ key: s, rank: r : (k, r) : *part{p_partkey: k, p_size: s, p_brand: b} }.", "SELECT p_brand AS b, p_partkey AS k, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part")
rule("take_until", "seg(s) := *customer{c_mktsegment: s}. ? seg(s), (c, n) = TakeUntil{ budget: 400, sum: n, key: c : (c, n) : *customer{c_custkey: c, c_nationkey: n, c_mktsegment: s} }.", "SELECT c, n, s FROM (SELECT c_custkey AS c, CAST(c_nationkey AS BIGINT) AS n, c_mktsegment AS s, sum(c_nationkey) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS t FROM customer) WHERE t <= 400")

# Sets, recursion, calls, order

rule("union_rules", 'rich(c) := *customer{c_custkey: c, c_acctbal: b}, b > 9000.0. rich(c) := *orders{o_custkey: c, o_totalprice: p}, p > 400000.0. ? rich(c).', "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 9000 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
rule("intersect_except", 'f(c) := *orders{o_custkey: c, o_orderstatus: "F"}. o(c) := *orders{o_custkey: c, o_orderstatus: "O"}. p(c) := *orders{o_custkey: c, o_orderstatus: "P"}. ? f(c), o(c), not p(c).', "(SELECT o_custkey AS c FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
rule("recursion", "link(a, b) := *nation{n_nationkey: a, n_regionkey: r}, *nation{n_nationkey: b, n_regionkey: r}, b = a + 5. reach(a, b) := link(a, b). reach(a, c) := reach(a, b), link(b, c). ? reach(a, b).", "WITH RECURSIVE link AS (SELECT CAST(x.n_nationkey AS BIGINT) AS a, CAST(y.n_nationkey AS BIGINT) AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND y.n_nationkey = x.n_nationkey + 5), reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a) SELECT a, b FROM reach")
rule("mutual_recursion", "step(a, b) := *nation{n_nationkey: a}, *nation{n_nationkey: b}, b = a + 1. even(0). even(b) := odd(a), step(a, b). odd(1). odd(b) := even(a), step(a, b). ? odd(n).", "SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation WHERE n_nationkey % 2 = 1")
rule("local_rules", '? where big(c) := *customer{c_custkey: c, c_acctbal: b}, b > 8000.0. big(c), *orders{o_custkey: c, o_orderkey: k, o_orderstatus: "P"}.', "SELECT o_custkey AS c, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 8000 AND o_orderstatus = 'P'")
rule("named_calls", 'place(c, n, r) := *customer{c_custkey: c, c_nationkey: n}, *nation{n_nationkey: n, n_regionkey: r}. ? place{r: 2, c: k}.', "SELECT c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
rule("order_by_limit", "? *orders{o_orderkey: k, o_totalprice: p} order by p desc, k.", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 25", limit=25)

# Graph and lifecycle over the corpus

_NODES = "WITH n AS (SELECT id FROM h UNION SELECT src FROM e UNION SELECT dst FROM e) "
for _name, _end, _more in (("in_degree", "dst", ""), ("out_degree", "src", ""), ("cite_count", "dst", " AND e.kind = 'Cites'")):
    rule(_name, f"? {_name}(h, n).", _NODES + f"SELECT n.id AS h, count(e.kind) AS n FROM n LEFT JOIN e ON e.{_end} = n.id{_more} GROUP BY n.id", corpus=True)
rule("discharge_count", "? discharge_count(h, n).", "SELECT h.id AS h, count(e.kind) AS n FROM h LEFT JOIN e ON e.dst = h.id AND e.kind = 'Discharges' GROUP BY h.id", corpus=True)
_REACH = "WITH r AS (SELECT {b} AS x FROM e WHERE {a} = '{s}' UNION SELECT e.{b} FROM r JOIN e ON e.{a} = r.x) SELECT x FROM r WHERE x <> '{s}'"
rule("upstream", '? upstream("doc/0.md", x).', _REACH.format(a="src", b="dst", s="doc/0.md"), corpus=True)
rule("downstream", '? downstream("C-7", x).', _REACH.format(a="dst", b="src", s="C-7"), corpus=True)
rule("upstream_of_end", '? upstream(x, "C-7").', _REACH.format(a="dst", b="src", s="C-7"), corpus=True)
rule("impact", '? impact("C-7", x, d).', "WITH r AS (SELECT src AS x, 1 AS d FROM e WHERE dst = 'C-7' AND kind IN ('DependsOn', 'Supersedes', 'Verifies') UNION SELECT e.src, r.d + 1 FROM r JOIN e ON e.dst = r.x AND e.kind IN ('DependsOn', 'Supersedes', 'Verifies') AND r.d < 60) SELECT CAST(min(d) AS BIGINT) AS d, x FROM r WHERE x <> 'C-7' GROUP BY x", corpus=True)
rule("neighborhood", '? neighborhood("doc/3.md", d, m), d <= 2.', "WITH u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT 'doc/3.md' AS m, 0 AS d UNION SELECT u.b, r.d + 1 FROM r JOIN u ON u.a = r.m WHERE r.d < 2) SELECT CAST(min(d) AS BIGINT) AS d, m FROM r GROUP BY m", corpus=True)
_DEAD = "status IS NOT NULL AND (status = 'superseded' OR status = 'resolved')"
rule("terminal", "? terminal(h).", f"SELECT id AS h FROM h WHERE {_DEAD}", corpus=True)
rule("active", "? active(h).", f"SELECT id AS h FROM h WHERE NOT ({_DEAD})", corpus=True)
rule("settled", "? settled(h).", "SELECT id AS h FROM h WHERE status IN ('authoritative', 'current', 'active', 'stable', 'living')", corpus=True)
rule("status_classes", "? lifecycle_status_classification(s, c, o).", "SELECT * FROM (VALUES ('superseded', 'terminal', 'project'), ('resolved', 'terminal', 'builtin'), ('draft', 'active', 'project'), ('current', 'active', 'project'), ('authoritative', 'settled', 'builtin'), ('current', 'settled', 'builtin'), ('active', 'settled', 'builtin'), ('stable', 'settled', 'builtin'), ('living', 'settled', 'builtin'), ('raw', 'pipeline', 'project'), ('draft', 'pipeline', 'project'), ('research', 'pipeline', 'project'), ('current', 'pipeline', 'project')) t(s, c, o)", corpus=True)
_PIPE = "(VALUES ('raw', 0), ('draft', 1), ('research', 2), ('current', 3)) o(s, n)"
rule("pipeline_position", "? pipeline_position(h, n).", f"SELECT id AS h, CAST(n AS BIGINT) AS n FROM h JOIN {_PIPE} ON status = s", corpus=True)
rule("pipeline_position_for", "? pipeline_position_for(s, n).", f"SELECT CAST(n AS BIGINT) AS n, s FROM {_PIPE}", corpus=True)
rule("obligation", "? obligation(h).", "SELECT id AS h FROM h WHERE namespace = 'C'", corpus=True)
rule("discharged", "? discharged(h).", "SELECT id AS h FROM h WHERE id IN (SELECT dst FROM e WHERE kind = 'Discharges')", corpus=True)
rule("undischarged", "? undischarged(h).", f"SELECT id AS h FROM h WHERE namespace = 'C' AND NOT ({_DEAD}) AND id NOT IN (SELECT dst FROM e WHERE kind = 'Discharges')", corpus=True)
_AGE = "greatest(date_diff('day', CAST(date AS DATE), DATE '2024-03-18'), 0)"
rule("freshness", "? freshness(h, d).", f"SELECT coalesce({_AGE}, 0) AS d, id AS h FROM h", corpus=True)
rule("token_estimate", "? token_estimate(h, n), n > 0.", r"SELECT id AS h, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM h JOIN documents ON id = concat('doc/', doc_id, '.md') WHERE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) > 0", corpus=True)
rule("changed_within", "? changed_within(h, 60).", "SELECT h.id AS h FROM h WHERE EXISTS (SELECT 1 FROM h m WHERE m.file = h.file AND m.date IS NOT NULL AND m.kind = 'file' AND CAST(m.date AS DATE) >= DATE '2024-03-18' - 60)", corpus=True)
rule("git_mtime", "? git_mtime(f, i).", "SELECT file AS f, concat(date, 'T12:00:00Z') AS i FROM h WHERE date IS NOT NULL", corpus=True)
rule("flux", "? flux(h, 90, n), n > 0.", "SELECT h.id AS h, CAST(CASE WHEN h.status = 'draft' THEN 1 ELSE 2 END AS BIGINT) AS n FROM h JOIN labels ON h.id = concat('doc/', doc_id, '.md')", corpus=True)
rule("time_block", '? at("snapshot:last") { *handle{id: h, status: then} }, *handle{id: h, status: now}, then != now.', "SELECT h.id AS h, h.status AS now, 'draft' AS then FROM h JOIN labels ON h.id = concat('doc/', doc_id, '.md') WHERE h.status IS DISTINCT FROM 'draft'", corpus=True)
rule("time_block_by_date", '? at("2024-01-11") { *handle{id: h, status: "raw"} }.', "SELECT h.id AS h FROM h JOIN labels ON h.id = concat('doc/', doc_id, '.md')", corpus=True)

# Content

rule("read_budget", '? *handle{id: h, kind: "file"}, read(h, 200, s, t, a, z, n).', r"SELECT a, h, least(n, 200) AS n, s, CASE WHEN n > 200 THEN concat(substring(text, 1, 800), chr(10), '...') ELSE text END AS t, CAST(len(string_split(text, chr(10))) AS BIGINT) AS z FROM (SELECT CAST(1 AS BIGINT) AS a, id AS h, concat(id, '#full') AS s, text, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM h JOIN documents ON id = concat('doc/', doc_id, '.md'))", corpus=True)
rule("read_full", '? *handle{id: h, kind: "file"}, token_estimate(h, n), n <= 8000, read_full(h, t).', r"SELECT h, n, t FROM (SELECT id AS h, text AS t, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM h JOIN documents ON id = concat('doc/', doc_id, '.md')) WHERE n <= 8000", corpus=True)
rule("match_lines", '? *handle{id: h, kind: "file"}, match("^The .*ing", h, l, x).', "SELECT h, CAST(l AS BIGINT) AS l, x FROM (SELECT id AS h, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS l FROM h JOIN documents ON id = concat('doc/', doc_id, '.md')) WHERE regexp_matches(x, '^The .*ing')", corpus=True)

# Introspection

rule("schema_rows", '? schema(n, "stored", g, d, p), n starts_with "*t".', """SELECT 'deterministic' AS d, g, n, 'facts' AS p FROM (VALUES
  ('*trail{session_id, step, timestamp, actor, corpus, verb, redacted_expr, input_hash, prelude_hash, visibility, retention}', '*trail'),
  ('*trail_ref{session_id, step, kind, ordinal, corpus, source, handle, span_id, score}', '*trail_ref'),
  ('*trail_generation{session_id, step, corpus, source, generation}', '*trail_generation')) t(g, n)""", corpus=True)
rule("predicate_docs", '? describe(n, d), n starts_with "currency".', """SELECT * FROM (VALUES ('Files that another supersedes.', 'currency_superseded'), ('Files that supersede another.', 'currency_successor'),
  ('Files that nothing supersedes.', 'currency_current'), ('Heads of successions.', 'currency_current_head'), ('superseded, current_head, current or unknown.', 'currency_disposition'),
  ('Files with a newer, operative sibling, neither superseded.', 'currency_suspect')) t(d, n)""", corpus=True, library=True)

# Standard library

rule("lib_hub", "? hub(h, n).", "WITH i AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e) SELECT id AS h, count(*) AS n FROM h JOIN i ON a = id GROUP BY id HAVING count(*) >= 10", corpus=True, library=True)
rule("lib_area_counts", "? area_file_count(a, n).", "SELECT area AS a, count(CASE WHEN kind = 'file' THEN 1 END) AS n FROM h WHERE area <> '' GROUP BY area", corpus=True, library=True)
rule("lib_cross_edges", "? area_cross_edges(a, n).", "WITH x AS (SELECT DISTINCT s.area AS area, t.id AS dst FROM e JOIN h s ON s.id = src JOIN h t ON t.id = dst WHERE s.area <> t.area) SELECT a.area AS a, count(x.dst) AS n FROM (SELECT DISTINCT area FROM h) a LEFT JOIN x ON x.area = a.area GROUP BY a.area", corpus=True, library=True)
rule("lib_broken_reference", "? broken_reference(s, t, f, l).", "SELECT DISTINCT src AS f, line AS l, src AS s, dst AS t FROM e WHERE dst NOT IN (SELECT id FROM h)", corpus=True, library=True)
rule("lib_stale_reference", "? stale_reference(s, t, f, a, b).", "SELECT DISTINCT x.status AS a, y.status AS b, x.file AS f, src AS s, dst AS t FROM e JOIN h x ON x.id = src JOIN h y ON y.id = dst WHERE e.kind = 'DependsOn' AND x.status IN ('draft', 'current', 'open') AND y.status = 'superseded'", corpus=True, library=True)
rule("lib_confidence_gap", "? confidence_gap(s, t, f, a, i, b, j).", f"WITH o AS (SELECT id, file, status, n FROM h JOIN {_PIPE} ON status = s) SELECT DISTINCT x.status AS a, y.status AS b, x.file AS f, CAST(x.n AS BIGINT) AS i, CAST(y.n AS BIGINT) AS j, src AS s, dst AS t FROM e JOIN o x ON x.id = src JOIN o y ON y.id = dst WHERE e.kind = 'DependsOn' AND x.n > y.n + 1", corpus=True, library=True)
rule("lib_obligations", "? undischarged_obligation(h, f).", f"SELECT id AS h, file AS f FROM h WHERE namespace = 'C' AND NOT ({_DEAD}) AND id NOT IN (SELECT dst FROM e WHERE kind = 'Discharges')", corpus=True, library=True)
rule("lib_multiple_discharge", "? multiple_discharge(h, f, n).", f"SELECT file AS f, id AS h, count(*) AS n FROM h JOIN e ON e.dst = id AND e.kind = 'Discharges' WHERE namespace = 'C' AND NOT ({_DEAD}) GROUP BY id, file HAVING count(*) >= 2", corpus=True, library=True)
rule("lib_currency", "? currency_disposition(h, d).", "WITH f AS (SELECT id, id IN (SELECT src FROM e WHERE kind = 'Supersedes') AS gone, id IN (SELECT dst FROM e WHERE kind = 'Supersedes') AS heir FROM h WHERE kind = 'file') SELECT CASE WHEN gone THEN 'superseded' WHEN heir THEN 'current_head' ELSE 'current' END AS d, id AS h FROM f UNION ALL SELECT 'unknown', id FROM h WHERE kind <> 'file'", corpus=True, library=True)
_ENTROPY = f"""
WITH live AS (SELECT * FROM h WHERE NOT ({_DEAD})), entropy AS (
  SELECT id AS h, 'undischarged' AS source, 5 AS w, 1 AS p FROM live WHERE namespace = 'C' AND id NOT IN (SELECT dst FROM e WHERE kind = 'Discharges')
  UNION SELECT src, 'broken_ref', 4, 0 FROM e WHERE dst NOT IN (SELECT id FROM h)
  UNION SELECT src, 'stale_dep', 3, 2 FROM e JOIN live x ON x.id = src AND x.status IS NOT NULL JOIN h y ON y.id = dst WHERE e.kind = 'DependsOn' AND y.status = 'superseded'
  UNION SELECT src, 'confidence_gap', 3, 4 FROM e JOIN (SELECT id, n FROM h JOIN {_PIPE} ON status = s) x ON x.id = src JOIN (SELECT id, n FROM h JOIN {_PIPE} ON status = s) y ON y.id = dst WHERE e.kind = 'DependsOn' AND x.n > y.n + 1
  UNION SELECT id, 'freshness_decay', 1, 5 FROM live WHERE kind = 'file' AND {_AGE} > 60
  UNION SELECT id, 'missing_meta', 1, 6 FROM live WHERE kind = 'file' AND status IS NULL
  UNION SELECT id, 'orphan_label', 1, 7 FROM h WHERE kind = 'label' AND id NOT IN (SELECT dst FROM e WHERE kind IN ('Cites', 'Discharges'))
)
"""
rule("lib_entropy", "? entropy(h, s).", _ENTROPY + "SELECT h, source AS s FROM entropy", corpus=True, library=True)
rule("lib_potential", "? potential(h, n).", _ENTROPY + "SELECT h, CAST(sum(w) AS BIGINT) AS n FROM entropy GROUP BY h", corpus=True, library=True)
rule("lib_primary_entropy", "? primary_entropy(h, s).", _ENTROPY + "SELECT h, s FROM (SELECT h, source AS s, row_number() OVER (PARTITION BY h ORDER BY w * 100 - p DESC) AS i FROM entropy) WHERE i = 1", corpus=True, library=True)
rule("lib_frontier", "? frontier(h, n).", _ENTROPY + "SELECT h, n FROM (SELECT h, CAST(sum(w) AS BIGINT) AS n FROM entropy GROUP BY h) ORDER BY n DESC, h LIMIT 25", corpus=True, library=True)
rule("lib_ranked_work", "? ranked_work(h, n, r).", _ENTROPY + "SELECT h, n, dense_rank() OVER (ORDER BY n DESC) AS r FROM (SELECT h, CAST(sum(w) AS BIGINT) AS n FROM entropy GROUP BY h)", corpus=True, library=True)
rule("lib_flow", '? flow(h, "advancing").', "SELECT h.id AS h FROM h JOIN labels ON h.id = concat('doc/', doc_id, '.md') WHERE status = 'current'", corpus=True, library=True)
#: The corpus as the relations that predicates are stated over.
_CORPUS = {
    "h": f"SELECT *, 'tables' AS source FROM ({HANDLE})",
    "e": f"SELECT *, src AS file, 'tables' AS source, row_number() OVER () AS i FROM ({EDGE})",
    "m": f"SELECT concat('doc/', doc_id, '.md') AS handle, 'quality' AS key, CAST(quality AS VARCHAR) AS value, 'authored_unmodeled' AS role, 'tables' AS source FROM labels UNION ALL SELECT id, 'status', status, 'authored_modeled', 'tables' FROM ({HANDLE}) WHERE kind = 'file' AND status IS NOT NULL",
    "cfg": "SELECT * FROM (VALUES ('convergence.ordering', 'raw', 0), ('convergence.ordering', 'draft', 1), ('convergence.ordering', 'research', 2), ('convergence.ordering', 'current', 3), ('convergence.active', 'draft', NULL), ('convergence.active', 'current', NULL), ('convergence.terminal', 'superseded', NULL), ('handles.linear', 'C', NULL), ('handles.rejected', 'X', NULL)) AS t(key, value, ordinal)",
    "concern": "SELECT '' AS name, '' AS member WHERE false",
    "snap": "SELECT concat('doc/', doc_id, '.md') AS id, snapshot, taken AS at, 'status' AS key, value FROM labels, (VALUES ('s1', '2024-01-10', 'raw'), ('s2', '2024-01-20', 'draft')) t(snapshot, taken, value)",
    "content": r"SELECT concat('doc/', doc_id, '.md') AS handle, concat('doc/', doc_id, '.md#full') AS span_id, text, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents",
    "mtimes": f"SELECT file, concat(date, 'T12:00:00Z') AS instant FROM ({HANDLE}) WHERE date IS NOT NULL",
}


def _stated(text: str, name: str) -> str:
    return library_queries.over(text, name, relations=_CORPUS)


rule("lib_diagnostic_codes", "code(c, s) := diagnostic(c, s, x, f, l, e). ? code(c, s), n = Count{ x : diagnostic(c, s, x, f, l, e) }.", _stated("SELECT code AS c, count(DISTINCT struct_pack(v := subject)) AS n, severity AS s FROM diagnostic GROUP BY code, severity", "diagnostic"), corpus_sql=False, corpus=True, library=True)
for _name, _predicate, _text in (
    ("lib_anchor", "ranked_anchor", "? ranked_anchor(h, r, s, w)."),
    ("lib_area_health", "area_health", "? area_health(a, g, f, e, x)."),
    ("lib_topic_pairs", "topic_pair", "? topic_pair(a, b, n)."),
    ("lib_recent_frontier", "recent_frontier", "? recent_frontier(h, r, d)."),
):
    _given = _text[_text.index("(") + 1 : _text.index(")")].split(", ")
    _sorted = ", ".join(f'"{p}" AS {x}' for x, p in sorted(zip(_given, REGISTRY[_predicate].params, strict=True)))
    rule(_name, _text, _stated(f"SELECT DISTINCT {_sorted} FROM {_predicate}", _predicate), corpus_sql=False, corpus=True, library=True)

# The statements of std_status_item take the last snapshot for a recent one, which the corpus's is not.
rule("lib_status", "? status_item(s, h, n, w).", corpus=True, library=True)

# Every predicate of the library, over a project of all shapes

QUERIES |= library_queries.QUERIES | feature_queries.QUERIES
SQL |= library_queries.SQL | feature_queries.SQL
