"""Queries of what those over tables, the corpus and the project leave out: rarer forms of rules, introspection, saved verbs,
sources of documents and code, batches, snapshots and row output, with the SQL that states their rows.

The documents and the source tree are made of tables: NOTES of suppliers, TOPICS of regions, TREE of nations."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .library_queries import over
from .sources import code, markdown, schema, store
from .sources.project import project
from .sources.tables import DAY, EDGE, HANDLE, engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def stated(name: str, sql: str):
    """Registers a function of (spark, sf_dir) under a name, with its SQL."""

    def put(build):
        QUERIES[name], SQL[name] = build, sql
        return build

    return put


def rule(name: str, text: str, sql: str, **options) -> None:
    stated(name, sql)(lambda spark, sf_dir: engine(spark, sf_dir, **options).query(text))


# Rules

rule("facts", 'likes("a", 1). likes("b", 2). likes("b", 3). ? likes(x, n), n >= 2.', "SELECT CAST(n AS BIGINT) AS n, x FROM (VALUES (2, 'b'), (3, 'b')) t(n, x)")
rule(
    "list_values",
    "reg(r) := *region{r_regionkey: r}. size(r, n) := reg(r), s = List{ k : *nation{n_nationkey: k, n_regionkey: r} }, n = Count{ k : *nation{n_nationkey: k}, k in s }. ? size(r, n).",
    "SELECT count(*) AS n, CAST(n_regionkey AS BIGINT) AS r FROM nation GROUP BY 2",
)
rule(
    "multi_atom_recursion",
    "up(a, b) := *nation{n_nationkey: a, n_regionkey: r}, *nation{n_nationkey: b, n_regionkey: r}, b = a + 5. far(a, b) := up(a, b). far(a, c) := far(a, b), far(b, c), *nation{n_nationkey: c}. ? far(a, b).",
    "SELECT CAST(x.n_nationkey AS BIGINT) AS a, CAST(y.n_nationkey AS BIGINT) AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey AND (y.n_nationkey - x.n_nationkey) % 5 = 0",
)
rule(
    "aggregate_over_negation",
    'nat(n) := *nation{n_nationkey: n}. ? nat(n), k = Count{ c : *customer{c_custkey: c, c_nationkey: n}, not *orders{o_custkey: c, o_orderstatus: "F"} }.',
    "SELECT count(c_custkey) AS k, CAST(n_nationkey AS BIGINT) AS n FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) ON c_nationkey = n_nationkey GROUP BY 2",
)
rule(
    "aggregate_over_time",
    '? n = Count{ h : at("snapshot:last") { *handle{id: h, status: "draft"} } }.',
    f"WITH h AS ({HANDLE}) SELECT count(*) AS n FROM h WHERE status = 'draft' OR id IN (SELECT concat('doc/', doc_id, '.md') FROM labels)",
    corpus=True,
)
rule("take_until_all", "? (k, q) = TakeUntil{ budget: 100000, sum: q, key: k : (k, q) : *orders{o_orderkey: k, o_custkey: q} }.", "SELECT k, q FROM (SELECT o_orderkey AS k, o_custkey AS q, sum(o_custkey) OVER (ORDER BY o_orderkey, o_custkey) AS t FROM orders) WHERE t <= 100000")
rule(
    "config_rows",
    "? *config{key: k, value: v, ordinal: n}, n != null.",
    "SELECT 'convergence.ordering' AS k, CAST(n AS BIGINT) AS n, v FROM (VALUES (0, 'raw'), (1, 'draft'), (2, 'research'), (3, 'current')) t(n, v)",
    corpus=True,
)

# Search over the corpus

_STEM = """CASE WHEN strlen(w) > 6 AND ends_with(w, 'ation') THEN left(w, length(w) - 5)
  WHEN strlen(w) > 5 AND ends_with(w, 'ing') THEN left(w, length(w) - 3 - CASE WHEN substring(w, length(w) - 3, 1) = substring(w, length(w) - 4, 1) THEN 1 ELSE 0 END)
  WHEN strlen(w) > 4 AND ends_with(w, 'ies') THEN concat(left(w, length(w) - 3), 'y')
  WHEN strlen(w) > 4 AND ends_with(w, 'ed') THEN left(w, length(w) - 2 - CASE WHEN substring(w, length(w) - 2, 1) = substring(w, length(w) - 3, 1) THEN 1 ELSE 0 END)
  WHEN strlen(w) > 3 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END"""
_TEXTS = f"""
h AS ({HANDLE}), e AS ({EDGE}),
f AS (
  SELECT id AS handle, CAST(NULL AS VARCHAR) AS span, 'identifier' AS field, 'identifier-substring' AS reason, id AS t FROM h
  UNION ALL SELECT id, NULL, 'title', 'title-substring', summary FROM h
  UNION ALL SELECT id, NULL, 'frontmatter:status', 'frontmatter-value-match', status FROM h
  UNION ALL SELECT id, NULL, 'frontmatter:namespace', 'frontmatter-value-match', namespace FROM h
  UNION ALL SELECT id, NULL, 'frontmatter:area', 'frontmatter-value-match', area FROM h
  UNION ALL SELECT id, NULL, 'frontmatter:kind', 'frontmatter-value-match', kind FROM h
  UNION ALL SELECT concat('doc/', doc_id, '.md'), NULL, 'frontmatter:quality', 'frontmatter-key-match', 'quality' FROM labels
  UNION ALL SELECT concat('doc/', doc_id, '.md'), NULL, 'frontmatter:quality', 'frontmatter-value-match', CAST(quality AS VARCHAR) FROM labels
  UNION ALL SELECT id, NULL, 'frontmatter:status', 'frontmatter-key-match', 'status' FROM h WHERE kind = 'file' AND status IS NOT NULL
  UNION ALL SELECT id, NULL, 'frontmatter:status', 'frontmatter-value-match', status FROM h WHERE kind = 'file' AND status IS NOT NULL
  UNION ALL SELECT concat('doc/', doc_id, '.md'), concat('doc/', doc_id, '.md#full'), 'body', 'body-substring', text FROM documents
), x AS MATERIALIZED (
  SELECT handle, span, field, reason,
         array_to_string(list_transform(list_transform(list_filter(string_split_regex(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: {_STEM}), lambda w: CASE WHEN strlen(w) > 6 AND ends_with(w, 'ure') THEN left(w, length(w) - 1) ELSE w END), ' ') AS t
  FROM f WHERE t IS NOT NULL AND t <> ''
), known AS (
  SELECT id AS handle, CASE WHEN file <> '' AND file <> id THEN file END AS parent,
         least(greatest(CAST(CASE WHEN kind <> 'label' AND status = 'current' THEN 0.08e0 ELSE 0e0 END AS FLOAT) + CAST(least(coalesce(n, 0) * 0.01e0, 0.12e0) AS FLOAT)
           + CAST(CASE WHEN kind <> 'file' THEN 0e0 WHEN id IN (SELECT src FROM e WHERE kind = 'Supersedes') THEN -0.12e0 WHEN heir AND status = 'current' THEN 0.1e0 ELSE 0e0 END AS FLOAT), CAST(0 AS FLOAT)), CAST(1 AS FLOAT)) AS boost
  FROM h LEFT JOIN (SELECT dst, count(*) AS n, bool_or(kind = 'Supersedes') AS heir FROM e GROUP BY dst) ON dst = id
)"""


def _hits(name: str, query: str, terms: list[tuple[str, int]]) -> str:
    """The hits of one query, whose normalised text and weighted terms are stated."""
    named = list(enumerate(terms))
    sums = " + ".join(f"w{i}" for i, _ in named)
    matched = " + ".join(f"CASE WHEN contains(t, '{t}') THEN w{i} ELSE 0e0 END" for i, (t, _) in named)
    score = "least(greatest({}, CAST(0 AS FLOAT)), CAST(1 AS FLOAT))"
    return f""",
{name}_k AS (SELECT least(count(*), 65535) AS n, {", ".join(f"least(count(*) FILTER (WHERE contains(t, '{t}')), 65535) AS n{i}" for i, (t, _) in named)} FROM x),
{name}_w AS (SELECT {", ".join(f"{w}e0 * (1e0 + 1.5e0 * (CAST(n - n{i} AS DOUBLE) / n)) AS w{i}" for i, (_, w) in named)} FROM {name}_k),
{name}_m AS (SELECT x.*, CAST(0e0 + {matched} AS FLOAT) AS matched, greatest(1e0, {sums}) AS target FROM x, {name}_w),
{name}_r AS (SELECT *, CASE WHEN contains(t, '{query}') THEN CAST(1 AS FLOAT) WHEN matched > 0 THEN CAST(0.35e0 + 0.55e0 * least(1e0, matched / target) AS FLOAT) END AS raw FROM {name}_m),
{name}_s AS (SELECT r.*, parent, {score.format("raw * CAST(CASE field WHEN 'identifier' THEN 1e0 WHEN 'title' THEN 0.95e0 WHEN 'body' THEN 0.82e0 ELSE 0.88e0 END AS FLOAT) + coalesce(boost, CAST(0 AS FLOAT))")} AS score FROM {name}_r r LEFT JOIN known k ON k.handle = r.handle WHERE raw IS NOT NULL),
{name}_d AS (SELECT handle, max(raw) FILTER (WHERE field IN ('identifier', 'title')) AS structural, max(score) AS direct FROM {name}_s GROUP BY handle),
{name}_c AS (SELECT parent, least(least(best + CAST(0.15e0 AS FLOAT), CAST(1 AS FLOAT)), CAST(0.99e0 AS FLOAT)) AS score, best FROM (SELECT parent, count(DISTINCT handle) AS n, max(raw) AS best FROM {name}_s WHERE parent IN (SELECT id FROM h) GROUP BY parent) WHERE n >= 2 AND best >= CAST(0.7e0 AS FLOAT)),
{name} AS (SELECT DISTINCT handle, span, CAST(score AS DOUBLE) AS score, reason, field, score < CAST(0.5e0 AS FLOAT) AS low FROM (SELECT handle, span, score, reason, field FROM {name}_s
  UNION ALL SELECT parent, NULL, score, 'parent-cluster', 'identifier' FROM {name}_c LEFT JOIN {name}_d ON handle = parent WHERE best > coalesce(structural, 0) AND score > coalesce(direct, 0)))"""


_THING = _hits("one", "the thing ering", [("the", 1), ("thing", 1), ("ering", 1), ("the th", 2), ("thing er", 2), ("the thing er", 3)])
_OPEN = _hits("two", "customer open", [("customer", 1), ("open", 1), ("customer open", 2)])
rule(
    "search_ranked",
    '? (h, s, f) = TopK{ k: 25, key: s : (h, s, f) : search("the thing ering", h, span, s, why, f, low) }.',
    f"WITH {_TEXTS.strip()}{_THING} SELECT field AS f, handle AS h, score AS s FROM (SELECT DISTINCT handle, span, score, reason, field FROM one) ORDER BY score DESC, handle, field LIMIT 25",
    corpus=True,
)
rule(
    "search_hits",
    'ask("the thing ering"). ask("customer open"). ? ask(q), search(q, h, span, s, why, f, low).',
    f"WITH {_TEXTS.strip()}{_THING}{_OPEN} SELECT field AS f, handle AS h, low, 'the thing ering' AS q, score AS s, span, reason AS why FROM one UNION ALL SELECT field, handle, low, 'customer open', score, span, reason FROM two",
    corpus=True,
)

# Introspection

PROGRAM = """@doc(name: "pair", text: "numbers side by side").
pair(1, 2).
pair(a, b) := pair(b, a).
@verb(name: "above", doc: "bigger ones", args: "least: Int = 2", query: "? pair(a, b), verb_arg(\\"least\\", x), a >= x.").
"""


def program(name: str, text: str, sql: str) -> None:
    """A query of an engine that knows no tables, only PROGRAM."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = Engine(spark, evaluation_day=DAY)
        made.load(PROGRAM, "pairs.dl")
        return made.query(text)

    stated(name, sql)(build)


program("predicate_rows", "? predicates(n, d, f, l).", "SELECT 'numbers side by side' AS d, 'pairs.dl' AS f, '2,3' AS l, 'pair' AS n")
program("source_lines", "? source_of(n, f, l).", "SELECT 'pairs.dl' AS f, l, 'pair' AS n FROM (VALUES ('2'), ('3')) t(l)")
program("verb_rows", "? verbs(n, q, d, o).", """SELECT 'bigger ones' AS d, 'above' AS n, '' AS o, '? pair(a, b), verb_arg("least", x), a >= x.' AS q""")
program("described_names", '? describe(n, d), n in ["pair", "above", "upstream"].', "SELECT * FROM (VALUES ('numbers side by side', 'pair'), ('bigger ones', 'above'), ('nodes reached along edges', 'upstream')) t(d, n)")
program("schema_of_facts", '? schema(n, k, g, d, p), n in ["*snapshot", "*config", "pair", "in_degree"].', """
SELECT 'deterministic' AS d, * FROM (VALUES ('*snapshot{corpus, snapshot, at, id, key, value}', 'stored', '*snapshot', 'facts'), ('*config{corpus, key, value, ordinal}', 'stored', '*config', 'facts'),
  ('pair/2', 'derived', 'pair', 'pairs.dl'), ('in_degree(h, n)', 'primitive', 'in_degree', 'engine')) t(g, k, n, p)""")
program("example_queries", '? examples(n, x), n in ["in_degree", "*concern"].', "SELECT * FROM (VALUES ('in_degree', '? in_degree(h, n).'), ('*concern', '? *concern{generation, name, member}.')) t(n, x)")
program("source_adapters", "? sources(n, r, c, d).", """
SELECT * FROM (VALUES ('Extract,Read,Search', 'markdown documents with front matter, links and labels', 'md', '**/*.md'), ('Extract,Search', 'source files, their classes and notes', 'code', 'source trees'),
  ('Extract', 'rows of registered tables', 'tables', 'any table Spark reads')) t(c, d, n, r)""")
program("repository_operations", "? repository_operation_capability(o, a, p, r).", "SELECT 'unavailable' AS a, 'mtimes' AS o, 'injected' AS p, 'no git_mtimes relation is registered' AS r")


@stated("verb_with_default", "SELECT CAST(2 AS BIGINT) AS a, CAST(1 AS BIGINT) AS b, CAST(2 AS BIGINT) AS x")
def verb_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Engine(spark, evaluation_day=DAY)
    made.load(PROGRAM, "pairs.dl")
    return made.verb("above")


# Saved verbs over the project


def verb(name: str, call: str, sql: str, **args) -> None:
    stated(name, sql)(lambda spark, sf_dir: project(spark, sf_dir).verb(call, **args))


verb("verb_check", "check", over("SELECT code, evidence, file, line, subject FROM diagnostic WHERE severity = 'error'", "diagnostic"))
verb("verb_handle", "handle", over("SELECT DISTINCT * FROM (SELECT kind, id AS other, 'self' AS side FROM h WHERE id = 'doc/3.md' UNION ALL SELECT kind, src, 'in' FROM e WHERE dst = 'doc/3.md' UNION ALL SELECT kind, dst, 'out' FROM e WHERE src = 'doc/3.md')", "h", "e"), id="doc/3.md")
verb(
    "verb_status",
    "status",
    over(
        "SELECT 'work' AS category, count(DISTINCT h) AS count, section AS name FROM status_item GROUP BY section UNION ALL SELECT 'findings', count(DISTINCT subject), severity FROM diagnostic GROUP BY severity"
        " UNION ALL SELECT 'scale', count(DISTINCT id), 'handles' FROM h UNION ALL SELECT 'scale', count(DISTINCT concat_ws('>', src, dst, kind, line)), 'edges' FROM e",
        "status_item", "diagnostic", "h", "e",
    ),
)


# Documents and code


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each supplier and a topic in versions for three regions, as (path, text)."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey")
    status = F.element_at(F.array(F.lit("draft"), F.lit('"current"'), F.lit("superseded (by others)")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    date = F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("date: 2024-01-"), F.lpad((F.col("s_suppkey") % 28 + 1).cast("string"), 2, "0"), F.lit("\n"))).otherwise("")
    text = F.format_string(
        "---\nstatus: %s\n%sdepends-on: [n%d.md, \"N-%d\"]\n---\n# %s\n\nSee N-%d and N-%d. Builds on §%d.1\n\n[far](../specs/topic-v%d.md)\n\n## Use\n\n`src/s%d.rs:4` and `N-999`\n\n```\nN-998\n```",
        status, date, F.col("s_suppkey") + 1, F.col("s_suppkey") % 10, F.col("s_name"), n, n + 100, F.col("s_suppkey") % 5, F.col("s_suppkey") % 3, F.col("s_suppkey") % 7,
    )
    notes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("notes/n"), k, F.lit(".md")).alias("path"), text.alias("text"))
    r = F.col("r_regionkey").cast("string")
    topics = spark.read.parquet(f"{sf_dir}/region.parquet").where("r_regionkey < 3")
    return notes.union(topics.select(F.concat(F.lit("specs/topic-v"), r, F.lit(".md")), F.concat(F.lit("# Topic "), r, F.lit("\n\nAbout N-"), r, F.lit("."))))


#: The notes (path, number, its nation, the line of the first paragraph) and topics, as the SQL of several queries.
_FILES = """WITH n AS (SELECT concat('notes/n', s_suppkey, '.md') AS path, s_suppkey AS k, s_nationkey AS nation, s_name AS name, CASE WHEN s_suppkey % 4 <> 0 THEN 8 ELSE 7 END AS line FROM supplier),
s AS (SELECT concat('specs/topic-v', r_regionkey, '.md') AS path, r_regionkey AS r FROM region WHERE r_regionkey < 3),
uses AS (SELECT concat('N-', nation) AS label, path, line, 'DependsOn' AS kind FROM n UNION ALL SELECT concat('N-', nation + 100), path, line, 'DependsOn' FROM n UNION ALL SELECT concat('N-', r), path, 3, 'Cites' FROM s)
"""


def documents(name: str, text: str, sql: str) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = Engine(spark, evaluation_day=DAY)
        found = markdown.extract(_notes(spark, sf_dir), written=made.written, corpus="notes", concerns={"notes": ["notes/*"], "zero": ["N-0"]})
        for relation, df in found.items():
            made.register(relation, df)
        return made.query(text)

    stated(name, _FILES + sql)(build)


documents("md_files", '? *handle{id: i, kind: "file", status: s, file: f, line: l, date: d, area: a, summary: t, namespace: n}.', """
SELECT 'notes' AS a, CASE WHEN k % 4 <> 0 THEN concat('2024-01-', lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0')) END AS d, path AS f, path AS i, CAST(1 AS BIGINT) AS l, '' AS n, CASE k % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'current' ELSE 'superseded' END AS s, name AS t FROM n
UNION ALL SELECT 'specs', NULL, path, path, 1, '', NULL, concat('Topic ', r) FROM s""")
documents("md_labels", '? *handle{id: i, kind: "label", namespace: n, file: f, line: l}.', "SELECT min(path) AS f, label AS i, CAST(arg_min(line, path) AS BIGINT) AS l, 'N' AS n FROM uses GROUP BY label")
documents("md_versions", '? *handle{id: i, kind: "version", file: f, status: s}.', "SELECT path AS f, concat('topic-v', r) AS i, CAST(NULL AS VARCHAR) AS s FROM s")
documents("md_external", '? *handle{id: i, kind: "external", file: f, line: l}, *meta{handle: i, key: "target_path", value: p}.', "SELECT min(path) AS f, concat('src/s', k % 7, '.rs:4') AS i, CAST(min(line + 6) AS BIGINT) AS l, concat('src/s', k % 7, '.rs') AS p FROM n GROUP BY k % 7")
documents("md_edges", "? *edge{from: a, to: b, kind: k, file: f, line: l}.", """
SELECT DISTINCT a, b, f, k, CAST(l AS BIGINT) AS l FROM (
  SELECT path AS a, CASE WHEN k + 1 IN (SELECT k FROM n) THEN concat('notes/n', k + 1, '.md') ELSE concat('n', k + 1, '.md') END AS b, path AS f, 'DependsOn' AS k, 1 AS l FROM n
  UNION ALL SELECT path, concat('N-', k % 10), path, 'DependsOn', 1 FROM n
  UNION ALL SELECT path, concat('section:', k % 5, '.1'), path, 'DependsOn', line FROM n
  UNION ALL SELECT path, concat('specs/topic-v', k % 3, '.md'), path, 'Cites', line + 2 FROM n
  UNION ALL SELECT path, concat('src/s', k % 7, '.rs:4'), path, 'Cites', line + 6 FROM n
  UNION ALL SELECT path, label, path, kind, line FROM uses
  UNION ALL SELECT concat('topic-v', r), concat('topic-v', r - 1), path, 'Supersedes', 1 FROM s WHERE r > 0)""")
documents("md_front_matter", '? *meta{handle: h, key: k, value: v, role: r}, r != "derived".', """
SELECT path AS h, 'status' AS k, 'authored_modeled' AS r, CASE k % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'current' ELSE 'superseded' END AS v FROM n
UNION ALL SELECT path, 'date', 'authored_modeled', concat('2024-01-', lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0')) FROM n WHERE k % 4 <> 0
UNION ALL SELECT path, 'depends-on', 'authored_modeled', concat('n', k + 1, '.md') FROM n UNION ALL SELECT path, 'depends-on', 'authored_modeled', concat('N-', k % 10) FROM n""")
documents("md_derived", '? *meta{handle: h, key: k, value: v, role: "derived"}.', """
SELECT path AS h, 'md.parent_dir' AS k, 'notes' AS v FROM n UNION ALL SELECT path, 'md.parent_dir', 'specs' FROM s
UNION SELECT concat('src/s', k % 7, '.rs:4'), 'external_class', 'code' FROM n UNION SELECT concat('src/s', k % 7, '.rs:4'), 'target_path', concat('src/s', k % 7, '.rs') FROM n""")
#: Spans of the documents: handle, id, first and last line, title, words.
_SPANS = """, spans AS (
SELECT path AS h, concat(path, '#full') AS i, line - 2 AS a, line + 10 AS z, '' AS t, 18 AS words FROM n
UNION ALL SELECT path, concat(path, '#h/', replace(lower(name), '#', '-'), '-', line - 2), line - 2, line + 3, name, 10 FROM n
UNION ALL SELECT path, concat(path, '#h/use-', line + 4), line + 4, line + 10, 'Use', 8 FROM n
UNION ALL SELECT path, concat(path, '#full'), 1, 3, '', 5 FROM s UNION ALL SELECT path, concat(path, '#h/topic-', r, '-1'), 1, 3, concat('Topic ', r), 5 FROM s)
"""
documents("md_spans", "? *span{id: i, handle: h, start_line: a, end_line: z, summary: t}, *content{handle: h, span_id: i, tokens: n, lines: l}.", _SPANS + "SELECT CAST(a AS BIGINT) AS a, h, i, CAST(z - a + 1 AS BIGINT) AS l, CAST(words AS BIGINT) AS n, t, CAST(z AS BIGINT) AS z FROM spans")
documents("md_concerns", "? *concern{name: n, member: m}.", "SELECT path AS m, 'notes' AS n FROM n UNION ALL SELECT DISTINCT label, 'zero' FROM uses WHERE label = 'N-0'")
documents("read_spans", '? *handle{id: h, kind: "file"}, read(h, 30, s, t, a, z, n).', _SPANS + """
, texts AS (SELECT path, k, line, concat('# ', name, chr(10), chr(10), 'See N-', nation, ' and N-', nation + 100, '. Builds on §', k % 5, '.1', chr(10), chr(10), '[far](../specs/topic-v', k % 3, '.md)', chr(10)) AS head,
  concat('## Use', chr(10), chr(10), '`src/s', k % 7, '.rs:4` and `N-999`', chr(10), chr(10), '```', chr(10), 'N-998', chr(10), '```') AS tail FROM n)
SELECT CAST(a AS BIGINT) AS a, h, CAST(words AS BIGINT) AS n, i AS s, CASE WHEN path IS NULL THEN (SELECT concat('# Topic ', r, chr(10), chr(10), 'About N-', r, '.') FROM s WHERE s.path = h) WHEN words = 18 THEN concat(head, chr(10), tail) ELSE head END AS t, CAST(z AS BIGINT) AS z
FROM (SELECT *, sum(words) OVER (PARTITION BY h ORDER BY a, z, i) AS total FROM spans) LEFT JOIN texts ON path = h WHERE total <= 30""")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source tree with a file for each nation, as (path, text)."""
    return spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr(
        "CASE WHEN n_nationkey % 7 = 6 THEN concat('target/r', n_nationkey, '.rs') WHEN n_nationkey % 5 = 4 THEN concat('src/gen', n_nationkey, '.py') WHEN n_nationkey % 3 = 0 THEN concat('tests/r', n_nationkey, '.py') WHEN n_nationkey % 3 = 1 THEN concat('src/r', n_nationkey, '.rs') ELSE concat('doc/r', n_nationkey, '.txt') END AS path",
        "CASE WHEN n_nationkey % 5 = 4 THEN concat('# @generated', chr(10)) ELSE concat('fn f() {}', chr(10), '// TODO: look at ', n_name, chr(10)) END AS text",
    )


_TREE = """WITH f AS (SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey % 5 = 4 THEN 'generated' WHEN n_nationkey % 3 = 0 THEN 'test' ELSE 'public' END AS class FROM nation WHERE n_nationkey % 7 <> 6 AND (n_nationkey % 5 = 4 OR n_nationkey % 3 <> 2)),
c AS (SELECT *, CASE class WHEN 'generated' THEN concat('src/gen', k, '.py') WHEN 'test' THEN concat('tests/r', k, '.py') ELSE concat('src/r', k, '.rs') END AS path FROM f)
"""


def tree(name: str, text: str, sql: str) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = Engine(spark, evaluation_day=DAY)
        for relation, df in code.extract(_tree(spark, sf_dir), corpus="tree").items():
            made.register(relation, df)
        return made.query(text)

    stated(name, _TREE + sql)(build)


tree("code_files", "? *handle{id: i, kind: k, status: s, area: a}.", "SELECT CASE class WHEN 'test' THEN 'tests' ELSE 'src' END AS a, path AS i, 'file' AS k, class AS s FROM c")
tree("code_facts", "? *meta{handle: h, key: k, value: v}.", """
SELECT path AS h, 'code.class' AS k, class AS v FROM c UNION ALL SELECT path, 'code.language', CASE class WHEN 'public' THEN 'rs' ELSE 'py' END FROM c
UNION ALL SELECT path, 'code.note.todo', concat('2: look at ', name) FROM c WHERE class <> 'generated'""")
tree("code_spans", "? *content{handle: h, span_id: i, lines: l, tokens: n}.", "SELECT path AS h, concat(path, '#full') AS i, CAST(CASE class WHEN 'generated' THEN 2 ELSE 3 END AS BIGINT) AS l, CAST(CASE class WHEN 'generated' THEN 2 ELSE 8 END AS BIGINT) AS n FROM c")

# Batches, snapshots, rows on disk


def _batch(spark: SparkSession, sf_dir: str, where: str, status: str) -> DataFrame:
    made = spark.read.parquet(f"{sf_dir}/nation.parquet").where(where)
    return schema.conform("handle", made.select(F.col("n_name").alias("native_id"), F.col("n_name").alias("id"), F.lit("file").alias("kind"), F.lit(status).alias("status")))


@stated("batch_merge", "SELECT n_name AS i, CASE WHEN n_nationkey % 5 = 1 THEN 'new' ELSE 'old' END AS s FROM nation WHERE n_nationkey % 5 <> 2")
def batch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full batch, then changes of some of its rows and retractions of others."""
    full = store.merge({}, {"handle": _batch(spark, sf_dir, "true", "old")}, "c", "s")
    gone = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey % 5 = 2").select(F.col("n_name").alias("native_id"))
    found = store.merge(full, {"handle": _batch(spark, sf_dir, "n_nationkey % 5 = 1", "new")}, "c", "s", delta=True, retracted=gone)
    return found["handle"].select(F.col("id").alias("i"), F.col("status").alias("s"))


@stated("batch_generations", "SELECT 'c' AS corpus, CAST(n AS BIGINT) AS current, source FROM (VALUES (2, 'a'), (1, 'b')) t(n, source)")
def batch_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = store.merge({}, {"handle": _batch(spark, sf_dir, "n_nationkey < 5", "old")}, "c", "a")
    two = store.merge(one, {"handle": _batch(spark, sf_dir, "n_nationkey >= 5", "old")}, "c", "b")
    return store.merge(two, {"handle": _batch(spark, sf_dir, "n_nationkey < 3", "new")}, "c", "a")["generation"]


def _place(made: Engine, name: str) -> str:
    """A new folder beside the engine's own tables."""
    made.written(made.spark.range(1))
    return f"{made.spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"


@stated("snapshot_history", f"""
WITH h AS ({HANDLE}), v AS (SELECT id, kind, status, namespace, file, date, area, summary FROM h), u AS (UNPIVOT v ON kind, status, namespace, file, date, area, summary INTO NAME key VALUE value)
SELECT snapshot, id, key, CASE WHEN snapshot = 's2' AND key = 'status' THEN 'done' ELSE value END AS value FROM u, (VALUES ('s1'), ('s2')) t(snapshot) WHERE value IS NOT NULL""")
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots, and none where nothing changed, written as lines and read back."""
    made = engine(spark, sf_dir, corpus=True)
    handles, none = made.relation("handle"), spark.createDataFrame([], schema.schema("snapshot"))
    one = made.written(store.take_snapshot(handles, none, "s1", "2024-01-01"))
    same = store.take_snapshot(handles, one, "s1b", "2024-01-02")
    two = store.take_snapshot(handles.withColumn("status", F.when(F.col("status").isNotNull(), F.lit("done"))), same, "s2", "2024-01-03")
    path = _place(made, "history")
    store.write_history(two, path)
    return store.read_history(spark, path)[0].select("snapshot", "id", "key", "value")


def sink(form: str, read: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    """Rows of a query written in one form and read back."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = engine(spark, sf_dir)
        path = _place(made, form)
        store.write_rows(made.query('? *customer{c_custkey: k, c_mktsegment: "BUILDING", c_name: n}.'), path, form)
        return read(spark, path)

    stated(f"rows_as_{form}", sql)(build)


_SOLD = "SELECT c_custkey AS k, c_name AS n FROM customer WHERE c_mktsegment = 'BUILDING'"
sink("ndjson", lambda spark, path: spark.read.schema("k long, n string").json(path), _SOLD)
sink("json", lambda spark, path: spark.read.schema("k long, n string").json(path), _SOLD)
sink("csv", lambda spark, path: spark.read.schema("k long, n string").csv(path), _SOLD)
sink("parquet", lambda spark, path: spark.read.parquet(path), _SOLD)
sink("text", lambda spark, path: spark.read.text(path), f"SELECT concat(k, chr(9), n) AS value FROM ({_SOLD})")
