"""The corpus pipeline: five stages from `documents` to packed batches.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept, written as Parquet and
reread in between. All but the last return the columns of `documents`.

Every stage takes an empty table (and returns one), rows that are repeated, texts of any length, nulls in any column and
further columns, which all stages but the last pass through. A null text goes with the language stage, as it has no letter;
a null doc_id, source or lang stays: without a doc_id a document is never the first with a line nor a copy of another, and
without a source it counts for no site. Of documents with one doc_id all go or stay by their own texts, and in the near
stage as members of their groups. Ties are settled by the smallest doc_id, in packing by hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, language, lines, packing
from tidemark.llm._shared import written

#: Near copies share this part of their word shingles of this length; op3 has values of its own.
NEAR_WORDS = 5
NEAR_SHARE = (80, 100)
#: Below this score none of the learned languages is likelier than the others by much.
MIN_SCORE = 0.4


def _beside(docs: DataFrame, names: tuple[str, ...], stage) -> DataFrame:
    """What the stage makes of docs, whose own columns of these names it would replace, with the columns of docs."""
    put = {c: f"_td_own_{c}" for c in names if c in docs.columns}
    return stage(docs.withColumnsRenamed(put)).select(*[F.col(put.get(c, c)).alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: those without letters, and those with a score under MIN_SCORE."""
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE)
    return _beside(docs, ("lang_pred", "score", "held_out"), lambda own: language.identify(own).where(known))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go, but for their first document; so do documents of which nothing is left."""

    def clean(own: DataFrame) -> DataFrame:
        found = lines.remove_boilerplate(own).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^ \t\r\n\x0B\f]"))
        return found.withColumn("n_chars", F.char_length("text").cast("long"))

    return _beside(docs, ("n_lines", "n_removed"), clean)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    return jaccard.one_of_each(docs, k=NEAR_WORDS, threshold=NEAR_SHARE)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; smaller hits are cut out of the others."""
    kept = decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in batches of optimal length buckets."""
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near", near_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL can't express the trained language stage; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
