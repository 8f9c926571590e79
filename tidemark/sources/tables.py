"""Tables as a corpus: the demonstration data as handles, edges, content, metadata and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: 2024-03-18, after all dates in the data.
DAY = 19_800

CONFIG = """
config convergence {
  ordering(["raw", "draft", "research", "current"]).
  active(["draft", "current"]).
  terminal(["superseded"]).
}
config handles { linear(["C"]). rejected(["X"]). }
"""

#: The corpus over the tables, as SQL that Spark and others understand.
HANDLE = """
SELECT concat('doc/', doc_id, '.md') AS id, 'file' AS kind,
       CASE lang WHEN 'en' THEN 'draft' WHEN 'de' THEN 'current' WHEN 'fr' THEN 'superseded' END AS status,
       '' AS namespace, concat('doc/', doc_id, '.md') AS file, 1 AS line,
       CASE WHEN doc_id % 5 <> 0 THEN concat('2024-01-', lpad(CAST(doc_id % 28 + 1 AS VARCHAR(2)), 2, '0')) END AS date,
       source AS area, substring(text, 1, 40) AS summary
FROM documents
UNION ALL
SELECT concat('C-', c_custkey), 'label', CASE c_mktsegment WHEN 'BUILDING' THEN 'open' WHEN 'MACHINERY' THEN 'resolved' ELSE 'draft' END,
       'C', concat('doc/', c_custkey % 300, '.md'), 1, NULL, concat('n', c_nationkey), c_name
FROM customer
"""
EDGE = """
SELECT concat('doc/', o_orderkey % 1100, '.md') AS src, concat('C-', o_custkey) AS dst,
       CASE o_orderstatus WHEN 'F' THEN 'Cites' WHEN 'O' THEN 'DependsOn' ELSE 'Discharges' END AS kind, o_orderkey AS line
FROM orders
UNION ALL
SELECT concat('doc/', doc_id, '.md'), concat('doc/', doc_id + 7, '.md'), 'DependsOn', 3 FROM documents WHERE doc_id % 3 = 0
UNION ALL
SELECT concat('doc/', doc_id, '.md'), concat('doc/', doc_id + 10, '.md'), 'Supersedes', 2 FROM documents WHERE doc_id % 10 = 0
"""


def engine(spark: SparkSession, sf_dir: str, *, corpus: bool = False, library: bool = False) -> Engine:
    """An engine over the tables; with corpus, over the corpus made of them as well. Files are opened when a
    query first reads their table."""
    made = Engine(spark, evaluation_day=DAY)
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for name in TABLES:
        made.register_lazily(name, lambda name=name: table(name))
    if corpus:
        for name, build in (("handle", _handle), ("edge", _edge), ("content", _content), ("span", _span), ("meta", _meta), ("snapshot", _snapshot), ("git_mtimes", _mtimes)):
            made.register_lazily(name, lambda build=build: build(spark, table))
        made.load(CONFIG, "demo", "base")
    if library:
        from ..library import install

        install(made)
    return made


def _base(df: DataFrame) -> DataFrame:
    return df.withColumns({"corpus": F.lit("demo"), "source": F.lit("tables"), "revision": F.lit("1")})


def _sql(spark: SparkSession, table, text: str) -> DataFrame:
    used = {t: table(t) for t in ("documents", "customer", "orders") if f"FROM {t}" in text}
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **used)


def _handle(spark, table) -> DataFrame:
    return _base(_sql(spark, table, HANDLE)).withColumns({"native_id": F.col("id"), "line": F.col("line").cast("long")})


def _edge(spark, table) -> DataFrame:
    edges = _sql(spark, table, EDGE).withColumnsRenamed({"src": "from", "dst": "to"})
    return _base(edges).withColumns({"file": F.col("from"), "native_id": F.concat_ws(">", F.col("from"), F.col("to"), "kind", F.col("line").cast("string"))})


def _content(spark, table) -> DataFrame:
    docs = table("documents").withColumn("handle", F.concat(F.lit("doc/"), "doc_id", F.lit(".md")))
    lines = F.size(F.split("text", "\n", -1)).cast("long")
    words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).cast("long")
    return _base(docs.select("handle", F.concat("handle", F.lit("#full")).alias("span_id"), lines.alias("lines"), "text", words.alias("tokens")))


def _span(spark, table) -> DataFrame:
    content = _content(spark, table)
    return content.select("corpus", "source", "revision", F.col("span_id").alias("id"), "handle", F.lit(1).cast("long").alias("start_line"), F.col("lines").alias("end_line"), F.lit("").alias("summary"))


def _labels(table) -> DataFrame:
    return table("labels").select(F.concat(F.lit("doc/"), "doc_id", F.lit(".md")).alias("handle"), "quality")


def _meta(spark, table) -> DataFrame:
    rated = _labels(table).select("handle", F.lit("quality").alias("key"), F.col("quality").cast("string").alias("value"), F.lit("authored_unmodeled").alias("role"))
    stated = _sql(spark, table, HANDLE).where("kind = 'file' and status is not null").select("id", F.lit("status"), "status", F.lit("authored_modeled"))
    return _base(rated.union(stated))


def _snapshot(spark, table) -> DataFrame:
    row = lambda name, at, status: F.struct(F.lit(name).alias("snapshot"), F.lit(at).alias("at"), F.lit(status).alias("value"))
    taken = F.explode(F.array(row("s1", "2024-01-10", "raw"), row("s2", "2024-01-20", "draft"))).alias("s")
    return _labels(table).select(F.col("handle").alias("id"), taken).select(F.lit("demo").alias("corpus"), "id", "s.snapshot", "s.at", F.lit("status").alias("key"), "s.value")


def _mtimes(spark, table) -> DataFrame:
    return _sql(spark, table, HANDLE).where("date is not null").select("file", F.concat("date", F.lit("T12:00:00Z")).alias("instant"))
