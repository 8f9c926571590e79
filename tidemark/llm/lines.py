"""Removal of lines that spread over many sites, with DataFrame functions only.

Lines are the pieces between newlines; a line without any word is never removed. Per line (two 64-bit hashes)
a HyperLogLog sketch of its sites is built and merged by aggregation. Where the estimate is within `band` of
the threshold, distinct sites are counted exactly; beyond it the estimate decides. A line on at least
`min_sites` sites is boilerplate: with keep_first it stays in the document of smallest id that has it, so that
the passage itself is not lost, and goes everywhere else.

`min_sites` is ten by definition, the same in OP9_SQL; the history gives no reason for ten rather than five. Lines on
fewer sites stay, license lines among them, and a corpus of fewer than ten sites loses no line: there, pass less.
Five would also take 43 lines of sf0.1 (20 sites), 41 of them of under 8 words ("En." is one), and 27 of sf0.01, of
which 12 have 8 to 49 words.

Defined cases: null text stays null (no lines); a null site counts as no site; a null id is never the first;
rows that repeat an id and text are treated alike, and each keeps a line whose first id they bear; a text of
boilerplate alone becomes empty; columns that bear the names of results are replaced, others pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import written

MIN_SITES = 10
LG_K = 11
BAND = 0.1


def _lines(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """One row per line: id, hash of the whole text, site, position, two hashes of the line."""
    rows = docs.select(F.col(doc_id).alias("i"), F.xxhash64(F.col(text)).alias("t"), F.col(site).alias("s"), F.split(F.col(text), "\n", -1).alias("parts"))
    one = rows.select("i", "t", "s", F.posexplode("parts").alias("p", "line")).where(F.col("line").rlike(r"[^ \t\x0B\f\r]"))
    return one.select("i", "t", "s", "p", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """h1, h2, first (smallest id) of each line on at least min_sites sites."""
    lines = _lines(docs, doc_id, text, site)
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("s", lg_k).alias("sketch"), F.min("i").alias("first")).select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("n"))
    # Lines clearly below the threshold, nearly all of them, are not written.
    found = written(sketched.where(F.col("n") >= min_sites * (1 - band)), "sites")
    near = found.where(F.col("n") <= min_sites * (1 + band))
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"]).groupBy("h1", "h2").agg(F.count_distinct("s").alias("exact")).where(F.col("exact") >= min_sites)
    sure = found.where(F.col("n") > min_sites * (1 + band)).select("h1", "h2", "first")
    return written(sure.union(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first")), "boilerplate")


def remove_boilerplate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", site: str = "source", keep_first: bool = True, **options) -> DataFrame:
    """docs with boilerplate lines taken out of text, and n_lines, n_removed."""
    docs = docs.drop("n_lines", "n_removed")
    bad = boilerplate(docs, doc_id=doc_id, text=text, site=site, **options)
    lines = _lines(docs, doc_id, text, site)
    gone = lines.join(bad, ["h1", "h2"])
    if keep_first:
        gone = gone.where(~F.col("i").eqNullSafe(F.col("first")))
    # Equal rows (id and text) share one list of positions.
    gone = written(gone.groupBy("i", "t").agg(F.collect_set("p").alias("gone")).select(F.col("i").alias("_td_i"), F.col("t").alias("_td_t"), "gone"), "removed")
    joined = docs.join(gone, F.col(doc_id).eqNullSafe(F.col("_td_i")) & (F.xxhash64(F.col(text)) == F.col("_td_t")), "left")
    # The pieces are split once per row, not once per line.
    parts = joined.withColumn("_td_parts", F.split(F.col(text), "\n", -1))
    kept = F.expr("transform(array_except(sequence(0, size(_td_parts) - 1), gone), i -> _td_parts[i])")
    return (
        parts.withColumn(text, F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
        .withColumn("n_lines", F.when(F.col("_td_parts").isNull(), 0).otherwise(F.size("_td_parts")).cast("long"))
        .withColumn("n_removed", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
        .drop("_td_i", "_td_t", "_td_parts", "gone")
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP9_SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents
), b AS (
  SELECT line, min(doc_id) AS first FROM l WHERE regexp_matches(line, '[^ \\t\\x0B\\f\\r]') GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), d AS (
  SELECT l.doc_id, l.p, l.line, b.line IS NOT NULL AND l.doc_id <> b.first AS gone FROM l LEFT JOIN b ON l.line = b.line
)
SELECT documents.doc_id, count(p) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id GROUP BY documents.doc_id
"""
