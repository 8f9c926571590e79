"""Token totals by source, language and tokenizer version, maintained from signed changes.

A change is an insert (+1 document, +tokens), a delete (-1, -tokens) or a revise (0, tokens - old_tokens) of
one document's count under one tokenizer version. A batch of changes is summed to one additive row per
(source, lang, tokenizer) and written under a name of its own; a marker that names those sums commits it. The marker
is written to a temporary file and renamed to the batch id, which fails where that batch has one: of two writers of one
batch one commits, and the sums of the other count for nothing. (A store whose rename is not atomic needs one writer
at a time.) Totals add up the sums of committed batches only, so a batch that failed half-way leaves no trace,
and applying a committed batch again changes nothing.

compact() folds committed batches into one, whose marker lists the ids folded as ranges; their own markers are then
removed, so that listings stay short, and the ids stay known. vacuum() removes sums that no marker names.

Defined cases: null source, lang or tokenizer are groups of their own; null tokens count as 0; an unknown op
is an error; repeated rows are repeated changes (batches, not rows, are idempotent); groups whose documents and
tokens are all back at 0 have no row; empty batches commit nothing but their marker; columns beside source, lang,
tokenizer, op, tokens and old_tokens are ignored, whatever their names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import new_path, written

KEYS = ("source", "lang", "tokenizer")
_SUMS = "source string, lang string, tokenizer string, docs long, tokens long"


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`."""
    return F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")


def alnum_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters."""
    return F.size(F.array_remove(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")).cast("long")


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _markers(self) -> list[dict]:
        """Committed batches: id, sums, and folded ranges of ids. A marker per batch not yet compacted."""
        at = self._at("commits")
        if not self._fs.exists(at):
            return []
        files = [x.getPath().toString() for x in self._fs.listStatus(at) if x.getPath().getName().endswith(".json")]
        found = [json.loads(r.value) for r in self.spark.read.text(files, wholetext=True).collect()] if files else []
        folded = [f for m in found for f in m["folds"]]
        # Folded markers that a compaction left when it was stopped don't count twice.
        return [m for m in found if not any(a <= m["batch"] <= b for a, b in folded)]

    def committed(self) -> list[int]:
        """Ids of batches that count: those with a marker and not folded into another."""
        return sorted(m["batch"] for m in self._markers())

    def seen(self, batch_id: int) -> bool:
        return any(m["batch"] == batch_id or any(a <= batch_id <= b for a, b in m["folds"]) for m in self._markers())

    def apply(self, batch_id: int, changes: DataFrame) -> bool:
        """Commits the batch unless it is committed. Returns whether it did."""
        if batch_id < 0:
            raise ValueError("batch ids are 0 or more; negative ones name compacted batches")
        if self.seen(batch_id):
            return False
        op, n, old = F.col("op"), F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null")))))
        tokens = F.when(op == "insert", n).when(op == "delete", -n).otherwise(n - old)
        return self._commit(batch_id, changes.select(*KEYS, docs.alias("docs"), tokens.alias("tokens")), [])

    def _commit(self, batch_id: int, signed: DataFrame, folds: list) -> bool:
        sums = f"{batch_id}-{uuid.uuid4().hex}"
        signed.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens")).write.parquet(f"{self.path}/sums/{sums}")
        self._fs.mkdirs(self._at("commits"))
        made, marker = self._at(f"commits/.{sums}.tmp"), self._at(f"commits/{batch_id}.json")
        out = self._fs.create(made)
        out.write(bytearray(json.dumps({"batch": batch_id, "sums": sums, "folds": folds}).encode()))
        out.close()
        if not self._fs.exists(marker) and self._fs.rename(made, marker):
            return True
        self._fs.delete(made, False)
        return False

    def _sums(self, markers: list[dict]) -> DataFrame:
        if not markers:
            return self.spark.createDataFrame([], _SUMS)
        return self.spark.read.schema(_SUMS).parquet(*[f"{self.path}/sums/{m['sums']}" for m in markers])

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        return self._sums(self._markers()).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Folds all committed batches into one."""
        markers = self._markers()
        if len(markers) < 2:
            return
        new = min(-1, *(m["batch"] for m in markers)) - 1
        folds: list[list[int]] = []
        for a, b in sorted([[m["batch"]] * 2 for m in markers] + [f for m in markers for f in m["folds"]]):
            if folds and a <= folds[-1][1] + 1:
                folds[-1][1] = max(b, folds[-1][1])
            else:
                folds.append([a, b])
        if self._commit(new, self._sums(markers), folds):
            for m in markers:
                self._fs.delete(self._at(f"commits/{m['batch']}.json"), False)

    def vacuum(self) -> None:
        """Removes sums of folded and failed batches. No batch may be being written, and no totals being read."""
        named = {m["sums"] for m in self._markers()}
        at = self._at("sums")
        for x in self._fs.listStatus(at) if self._fs.exists(at) else []:
            if x.getPath().getName() not in named:
                self._fs.delete(x.getPath(), True)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over the whole table: counts of all documents under two tokenizer versions; deletion of the
    documents of less than 200 characters from the first; revised counts of the rest under the first. Each
    batch is delivered twice."""
    text = F.coalesce("text", F.lit(""))
    counted = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang", F.char_length(text).alias("chars"), words(text).alias("words"), alnum_words(text).alias("alnum"), F.octet_length(text).cast("long").alias("octets"))
    counted = written(counted, "counts")

    def change(op, tokenizer, tokens, old, rows=counted):
        return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(op).alias("op"), F.col(tokens).alias("tokens"), (F.lit(None).cast("long") if old is None else F.col(old)).alias("old_tokens"))

    batches = [
        change("insert", "words-1", "words", None),
        change("insert", "bytes-1", "octets", None),
        change("delete", "words-1", "words", None, counted.where("chars < 200")),
        change("revise", "words-1", "alnum", "words", counted.where("chars >= 200")),
    ]
    rollup = Rollup(spark, new_path(spark, "rollup"))
    for i in (0, 1, 0, 2, 1, 3, 2, 3):
        rollup.apply(i, batches[i])
    rollup.compact()
    return rollup.totals()


OP10_SQL = r"""
WITH c AS (
  SELECT source, lang, length(coalesce(text, '')) AS chars, strlen(coalesce(text, '')) AS octets,
         len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS alnum
  FROM documents
)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS docs, CAST(sum(alnum) AS BIGINT) AS tokens FROM c WHERE chars >= 200 GROUP BY source, lang
UNION ALL
SELECT source, lang, 'bytes-1', count(*), CAST(sum(octets) AS BIGINT) FROM c GROUP BY source, lang
"""
