"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over whole texts.

Items and documents are lower-cased (A-Z only) and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.
Windows are `n` consecutive words of an item (an item of 1 to n-1 words is one window of its own length).
Executors slide over every document word, look each window's 64-bit hash up in the set and then compare
the bytes of the words, so that a hash collision never counts as a hit.

The benchmark's windows are cut and made distinct on executors. The set is broadcast only in shards of about
`max_windows` pairs of a window and an item, as plain arrays; pairs are dealt out by hash, so that a window that many
items share is no heavier than others. A benchmark beyond that bound is scanned in several passes with the same result:
documents with their hits are written between passes and the last shard is let go, so memory is that of one shard. A
document's hits are merged ranges, and its items are listed once.

Defined cases: null and wordless texts (documents or items) have no words and no hits; items with a null id hit
like any other, and all of them together count as one item, which is null and last in `items`; repeated rows are
scanned one by one, and rows repeating an item's id are one item; an empty table of documents gives no rows, an empty
benchmark leaves every document clean; texts of any length are scanned whole; extra columns pass through, those that
bear the names of results give way to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as W
from ._shared import small_batches, written

N = 13
MAX_WINDOWS = 500_000
_BITS = 22
_PLACE = ("start", "end", "begin_byte", "end_byte")
_FOUND = [T.StructField("_td_words", T.LongType()), T.StructField("_td_hits", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in _PLACE]))), T.StructField("_td_items", T.ArrayType(T.StringType()))]
_OWN = ("n_words", "n_hit", "n_items", "items", "contaminated")


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    raw = data[int(starts[0]) : int(ends[-1])].tobytes()
    base = int(starts[0])
    return b" ".join(raw[s - base : e - base] for s, e in zip(starts.tolist(), ends.tolist(), strict=True))


def windows(benchmark: DataFrame, item_id: str, text: str, n: int = N) -> DataFrame:
    """k (number of words), words (joined by a blank) and i (item) of all windows, each once."""

    def cut(batches):
        for batch in batches:
            for first, end, data, offsets in W.slices(batch.column(1)):
                data = W.LOWER[data]
                starts, ends, rows = W.spans(data, offsets, W.ALNUM)
                cuts = W.bounds(rows, end - first)
                for row in range(end - first):
                    a, b = int(cuts[row]), int(cuts[row + 1])
                    size = min(n, b - a)
                    for at in range(a, b if size else a, 1 << 14):
                        last = min(at + (1 << 14), b - size + 1)
                        found = [_joined(data, starts[j : j + size], ends[j : j + size]) for j in range(at, last)]
                        yield pa.RecordBatch.from_arrays([pa.array([size] * len(found), pa.int32()), pa.array(found, pa.binary()), pa.array([batch.column(0)[first + row].as_py()] * len(found), pa.string())], names=["k", "words", "i"])

    return benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null").mapInArrow(cut, "k int, words binary, i string").distinct()


class Shard:
    """Windows of one length with their items, as arrays: hashes in order, the words of each, and items by number."""

    def __init__(self, size: int, words: pa.Array, items: pa.Array):
        coded = words.dictionary_encode()
        data, offsets = W.buffers(coded.dictionary.cast(pa.string()))
        starts, ends, rows = W.spans(data, offsets, ~W.table((0x20, 0x20)))
        whole, _ = W.runs(W.span_hash(data, starts, ends), rows, size)
        order = np.argsort(whole, kind="stable")
        self.size, self.hashes = size, whole[order]
        self.data, self.begin, self.end = data.copy(), offsets[:-1][order], offsets[1:][order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # Items by window.
        named = items.dictionary_encode()
        self.names = [*named.dictionary.to_pylist(), None]
        code = place[coded.indices.to_numpy()]
        by = np.argsort(code, kind="stable")
        self.items = named.indices.fill_null(len(self.names) - 1).to_numpy(zero_copy_only=False)[by]
        self.cuts = np.searchsorted(code[by], np.arange(len(order) + 1))

    def bits(self) -> np.ndarray:
        out = np.zeros(1 << _BITS, bool)
        out[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return out

    def find(self, hashed: int, words: bytes) -> np.ndarray | None:
        """Numbers of the items of the window with these words."""
        at = int(np.searchsorted(self.hashes, np.uint64(hashed)))
        while at < len(self.hashes) and int(self.hashes[at]) == hashed:
            if self.data[self.begin[at] : self.end[at]].tobytes() == words:
                return self.items[self.cuts[at] : self.cuts[at + 1]]
            at += 1
        return None


def _pass(docs: DataFrame, text: str, shards: list[Shard], first_pass: bool):
    """docs with the hits of these windows, beside those that earlier passes found; and the broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(shards)
    schema = T.StructType([*docs.schema.fields, *_FOUND]) if first_pass else docs.schema
    hit_type = pa.list_(pa.struct([(c, pa.int64()) for c in _PLACE]))
    filters: list[np.ndarray] = []

    def scan(batches):
        if not filters:
            filters.extend(s.bits() for s in sent.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            counts, hits, items = np.zeros(len(column), np.int64), [[] for _ in range(len(column))], [set() for _ in range(len(column))]
            for first, end, data, offsets in W.slices(column):
                data = W.LOWER[data]
                starts, ends, rows = W.spans(data, offsets, W.ALNUM)
                counts[first:end] = np.bincount(rows, minlength=end - first)
                hashes = W.span_hash(data, starts, ends)
                cuts = W.bounds(rows, end - first)
                for shard, bits in zip(sent.value, filters, strict=True):
                    whole, at = W.runs(hashes, rows, shard.size)
                    for i in np.flatnonzero(bits[(whole >> np.uint64(64 - _BITS)).astype(np.int64)]).tolist():
                        word = int(at[i])
                        found = shard.find(int(whole[i]), _joined(data, starts[word : word + shard.size], ends[word : word + shard.size]))
                        if found is None:
                            continue
                        row = int(rows[word])
                        items[first + row].update(shard.names[k] for k in found.tolist())
                        own, a, b = hits[first + row], word - int(cuts[row]), int(ends[word + shard.size - 1]) - int(offsets[row])
                        # Windows of one length come in order: one that meets the last hit lengthens it.
                        if own and own[-1]["start"] <= a <= own[-1]["end"]:
                            own[-1]["end"], own[-1]["end_byte"] = max(own[-1]["end"], a + shard.size), max(own[-1]["end_byte"], b)
                        else:
                            own.append({"start": a, "end": a + shard.size, "begin_byte": int(starts[word]) - int(offsets[row]), "end_byte": b})
            columns = list(batch.columns)
            if not first_pass:
                columns, (old_hits, old_items) = columns[:-3], columns[-2:]
                hits = [a.as_py() + b for a, b in zip(old_hits, hits, strict=True)]
                items = [set(a.as_py()) | b for a, b in zip(old_items, items, strict=True)]
            listed = [sorted(x - {None}) + [None] * (None in x) for x in items]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array(hits, hit_type), pa.array(listed, pa.list_(pa.string()))], names=schema.names)

    return docs.mapInArrow(scan, schema), sent


def annotate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with `_td_words` (their number), `_td_hits` (word and byte ranges inside verified windows, which may
    overlap) and `_td_items` (ids of the items hit, sorted, a null id last)."""
    small_batches(docs.sparkSession)
    found = written(windows(benchmark, item_id, item_text, n), "windows")
    shards = max(1, -(-found.count() // max_windows))
    found = found.withColumn("shard", F.pmod(F.xxhash64("k", "words", "i"), F.lit(shards)))
    out, sent = docs, None
    for at in range(shards):
        held = found.where(F.col("shard") == at).select("k", "words", "i").toArrow().combine_chunks()
        sizes = held["k"].to_numpy()
        parts = [(k, held.take(pa.array(np.flatnonzero(sizes == k))).combine_chunks()) for k in np.unique(sizes).tolist()]
        if sent is not None:
            out = written(out, "pass")
            sent.destroy()
        out, sent = _pass(out, text, [Shard(k, t["words"].combine_chunks(), t["i"].combine_chunks()) for k, t in parts], at == 0)
    return out


def hit_words() -> Column:
    """Number of words inside any hit: overlapping ranges are merged, then their lengths are summed."""
    return F.expr("""
        aggregate(
            array_sort(transform(_td_hits, h -> struct(h.start as a, h.end as b))),
            struct(0L as total, 0L as upto),
            (s, h) -> struct(s.total + greatest(h.b - greatest(h.a, s.upto), 0L) as total, greatest(h.b, s.upto) as upto),
            s -> s.total)""")


def report(docs: DataFrame, benchmark: DataFrame, *, share: tuple[int, int] = (1, 20), **options) -> DataFrame:
    """annotate() with n_words, n_hit, n_items, items and contaminated (n_hit > 0 and n_hit / n_words of at
    least share). Columns of docs that bear these names give way to them."""
    return (
        annotate(docs.drop(*_OWN), benchmark, **options)
        .withColumn("n_hit", hit_words())
        .withColumn("items", F.col("_td_items"))
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share[1] >= F.col("_td_words") * share[0]))
        .withColumnRenamed("_td_words", "n_words")
    )


def remove(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", share: tuple[int, int] = (1, 20), **options) -> DataFrame:
    """Contaminated documents go; from the others the hit spans are cut out. Columns are those of docs."""
    n_hit = F.col("_td_hit")
    found = annotate(docs, benchmark, text=text, **options).withColumn("_td_hit", hit_words())
    # Byte positions: the text is cut as bytes. Merged ranges in order, then the pieces between them.
    cut = F.expr(f"""
        decode(aggregate(
            array_sort(transform(_td_hits, h -> struct(h.begin_byte as a, h.end_byte as b))),
            struct(cast('' as binary) as kept, 0L as upto),
            (s, h) -> struct(concat(s.kept, substring(encode(`{text}`, 'utf-8'), cast(s.upto + 1 as int), cast(greatest(h.a - s.upto, 0L) as int))) as kept, greatest(h.b, s.upto) as upto),
            s -> concat(s.kept, substring(encode(`{text}`, 'utf-8'), cast(s.upto + 1 as int)))), 'utf-8')""")
    clean = (n_hit == 0) | (n_hit * share[1] < F.col("_td_words") * share[0])
    return found.where(clean).withColumn(text, F.when(n_hit > 0, cut).otherwise(F.col(text))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP6_SQL = r"""
WITH norm AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM norm, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)
), hits AS (
  SELECT grams.doc_id, grams.i, grams.k, wins.item_id FROM grams JOIN wins USING (k, g)
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT norm.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM norm LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
