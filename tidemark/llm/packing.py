"""Packing into optimal length buckets.

Texts longer than `max_len` tokens are cut into pieces of max_len, none is truncated. The histogram of piece
lengths over all texts has at most max_len rows whatever the input, and is all that reaches the driver: there
dynamic programming chooses the bucket boundaries that minimise the padding of all pieces. Inside a bucket
pieces are shuffled by a hash and dealt into batches of as many pieces as fit `budget` padded tokens; every
batch is full but the bucket's last. Positions inside a bucket come from row numbers inside many small hash
slices plus the sizes of the slices before, so no bucket passes through one task.

Tokens are words `[^\\x20\\x09-\\x0D]+`, and each piece comes with its text: from its first word (the first piece:
from the start of the text) up to the first word of the next, so that a document's pieces in order are its text.
With a `count` of its own, of some tokenizer, pieces are ranges of tokens without a text. Pieces are written once; their
texts pass through one shuffle, by slice.

Defined cases: null or tokenless text has one row without bucket or batch (n_tokens 0, text as it is); rows repeating
an id are packed separately, and equal pieces of equal ids take places in any order; a null id is packed as well; an
empty table gives no rows; texts of any length are cut whole; columns of docs beside id and text, whatever their
names, are not in the result, whose rows are pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _words as W
from ._shared import small_batches, written

MAX_LEN = 2048
BUCKETS = 8
BUDGET = 65_536
SLICES = 1024
#: Bytes of text a batch of pieces holds, about.
_BATCH_BYTES = 4 << 20


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with least total padding; the last is the greatest length."""
    order = np.argsort(lengths)
    size, n = np.array(lengths, np.int64)[order], np.array(counts, np.int64)[order]
    m = len(size)
    if not m:
        return []
    rows, total = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * size))
    # cost[i, j]: padding of lengths i..j-1 in one bucket
    best = np.append(0.0, np.full(m, np.inf))
    back = np.zeros((min(buckets, m) + 1, m + 1), np.int64)
    for k in range(1, min(buckets, m) + 1):
        now = np.full(m + 1, np.inf)
        for j in range(1, m + 1):
            cost = best[:j] + size[j - 1] * (rows[j] - rows[:j]).astype(float) - (total[j] - total[:j])
            back[k, j] = int(cost.argmin())
            now[j] = cost[back[k, j]]
        best = now
    out, j = [], m
    for k in range(min(buckets, m), 0, -1):
        out.append(int(size[j - 1]))
        j = int(back[k, j])
    return out[::-1]


def _cut(docs: DataFrame, doc_id: str, text: str, max_len: int) -> DataFrame:
    """doc_id, piece, first_token, n_tokens and text of the pieces of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            column = batch.column(1)
            for first, end, data, offsets in W.slices(column):
                starts, _, of = W.spans(data, offsets, W.SPACED)
                words = W.bounds(of, end - first)
                size = np.diff(words)
                pieces = np.maximum(-(-size // max_len), 1)
                row = np.repeat(np.arange(end - first), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = offsets[row]
                later = piece > 0
                begin[later] = starts[words[row[later]] + piece[later] * max_len]
                stop = np.append(begin[1:], offsets[-1])
                n = np.minimum(size[row] - piece * max_len, max_len)
                held = np.cumsum(stop - begin) // _BATCH_BYTES
                for part in np.unique(held).tolist():
                    at = np.flatnonzero(held == part)
                    a, b = int(begin[at[0]]), int(stop[at[-1]])
                    cuts = np.append(begin[at], b).astype(np.int64) - a
                    texts = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(cuts), pa.py_buffer(data[a:b].tobytes())).cast(pa.string())
                    whole = pa.array(first + row[at])
                    texts = pc.if_else(column.take(whole).is_valid(), texts, pa.scalar(None, pa.string()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(whole), pa.array(piece[at]), pa.array(piece[at] * max_len), pa.array(n[at]), texts], names=["doc_id", "piece", "first_token", "n_tokens", "text"])

    return rows.mapInArrow(cut, f"doc_id {kind}, piece long, first_token long, n_tokens long, text string")


def _counted(docs: DataFrame, doc_id: str, count: Column, max_len: int) -> DataFrame:
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(count, F.lit(0)).cast("long").alias("all"))
    starts = F.when(F.col("all") > 0, F.sequence(F.lit(0).cast("long"), F.col("all") - 1, F.lit(max_len).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return counted.select("doc_id", "all", F.posexplode(starts).alias("piece", "first_token")).select("doc_id", F.col("piece").cast("long").alias("piece"), "first_token", F.least(F.col("all") - F.col("first_token"), F.lit(max_len)).alias("n_tokens"), F.lit(None).cast("string").alias("text"))


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", count: Column | None = None, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, first_token, n_tokens, bucket (its upper bound), padded_tokens (the
    same), batch (a string, unique over all buckets), slot in the batch, and text. count: the number of tokens of a
    row, words by default."""
    if budget < max_len:
        raise ValueError("budget must hold a piece of max_len tokens")
    pieces = written(_cut(docs, doc_id, text, max_len) if count is None else _counted(docs, doc_id, count, max_len), "pieces")

    histogram = pieces.where("n_tokens > 0").groupBy("n_tokens").count().collect()
    bounds = boundaries([r.n_tokens for r in histogram], [r["count"] for r in histogram], buckets)
    bucket = F.lit(None).cast("long")
    for b in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bucket)
    full = pieces.where("n_tokens > 0").withColumn("bucket", bucket).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "piece"))
    full = full.withColumn("slice", F.pmod("h", F.lit(SLICES)))

    sizes = full.groupBy("bucket", "slice").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket", "slice").orderBy("h", "doc_id", "piece", "n_tokens")
    placed = full.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(offsets), ["bucket", "slice"])  # BUCKETS * SLICES rows at most
    at, each = F.col("before") + F.col("rank") - 1, F.expr(f"{int(budget)} div bucket")
    packed = placed.select("doc_id", "piece", "first_token", "n_tokens", "bucket", F.col("bucket").alias("padded_tokens"), F.concat_ws("-", "bucket", F.floor(at / each).cast("long")).alias("batch"), F.pmod(at, each).cast("long").alias("slot"), "text")
    none = pieces.where("n_tokens = 0").select("doc_id", "piece", "first_token", "n_tokens", *[F.lit(None).cast(t).alias(c) for c, t in (("bucket", "long"), ("padded_tokens", "long"), ("batch", "string"), ("slot", "long"))], "text")
    return packed.union(none)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all pieces, and the length of their texts."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return packed.withColumn("n_chars", F.char_length("text").cast("long")).drop("text")
