"""N-gram Jaccard join with several global token orders, and its classes of linked documents.

A document's set is its distinct k-word shingles. Two documents link when the Jaccard similarity of their
sets reaches a threshold. For any total order of all shingles, two sets of n and m shingles that link must
share a shingle among the first `n - ceil(t * n) + 1` of the one and `m - ceil(t * m) + 1` of the other; this
holds for each order on its own, so a pair has to pass the filter of every order before it is verified:

* order 0 puts rare shingles first, by a count sketch over the shingles of all documents, with a cell for some bytes of
  the input and 2 ** 24 cells at most: too few cells hide the shingles that dozens of documents share;
* orders 1 and 2 are two independent pseudo-random permutations.

Order 0 generates candidates (its prefixes are joined on shingles), in a way that no large group is ever
gathered or expanded into pairs:

1. Documents with equal sets are one class; only a class's smallest doc_id goes on.
2. Prefix shingles of 2 to `PAIRED` classes give pairs of classes of fitting sizes. A class follows the smallest
   class it is paired with, and the followers of one leader are dealt out by hash into chunks of bounded size. A
   pair belongs to the tile of its two chunks, and only classes with a pair are sent to a tile.
3. Shingles of more classes give no pairs: there each class follows the smallest class with such a shingle, and
   followers are dealt into chunks likewise. First each chunk is a tile with `PIVOTS` followers of its leader in common:
   variants of one text meet the same pivots, so that nearly all of them are connected in work that grows with their
   number. Then followers are dealt anew, those already connected in large numbers into chunks of their own, and any
   two chunks with such a shingle in common make a tile, but for chunks of one component.
4. A tile thus holds two bounded chunks at most. First it gets short signatures, the numbers of shingles in
   each of a few buckets: the sum of the smaller numbers bounds the intersection of two sets from above, and
   classes without a partner that this bound allows leave the tile.
5. Then it gets texts: the prefix filters of all orders and the sizes are intersected, pairs that pass are
   verified exactly on their shingle sets, and pairs already connected inside the tile need no verification. A
   tile returns a spanning forest of the links found, never all pairs. Tiles go in rounds, one after the other, dealt
   by hash: those of a round send some multiple of all signatures, then of all texts, so that disk is bounded however
   many tiles there are.
6. Links become components by alternating large-star and small-star steps.

Every linked pair shares a prefix shingle, so its classes meet in a tile or are connected before, and both ends get one
component.

Defined cases: null or wordless text has an empty set (n_shingles 0) and links with nothing; a text with fewer
than k words has one shingle, the whole sequence; rows are compared one by one, rows repeating a doc_id too;
a null doc_id keeps its n_shingles and gets a null component_id. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._shared import last_kept, small_batches, written

K = 4
THRESHOLD = (85, 100)
#: Least and most bits of a cell's number in the sketch, and bytes of the input a cell.
SKETCH_BITS = (19, 24)
CELL_BYTES = 32
BLOCKS = 128
#: A round of tiles sends so many times the signatures of all classes, or texts of so many times the shingles of all, and
#: LEAST_ROUND bytes of signatures or shingles at least.
ROUND_SIGNS = 8
ROUND_TEXTS = 1
LEAST_ROUND = 256 << 20
CHUNK_DOCS = 128
CHUNK_SHINGLES = 50_000
PAIRED = 32
PIVOTS = 8
_ORDERS = (np.uint64(0x8BB84B93962EACC9), np.uint64(0x2D358DCCAA6C78A5))


def shingle_sets(column: pa.Array, k: int):
    """For each row the sorted distinct shingle hashes."""
    for first, end, data, offsets in W.slices(column):
        data = W.LOWER[data]
        starts, ends, rows = W.spans(data, offsets, W.SPACED)
        hashes = W.span_hash(data, starts, ends)
        words = W.bounds(rows, end - first)
        whole, at = W.runs(hashes, rows, k)
        cuts = W.bounds(rows[at], end - first)
        for i in range(end - first):
            n = int(words[i + 1] - words[i])
            if n >= k:
                yield np.unique(whole[cuts[i] : cuts[i + 1]])
            elif n:
                yield W.runs(hashes[words[i] : words[i + 1]], rows[words[i] : words[i + 1]], n)[0]
            else:
                yield np.zeros(0, np.uint64)


def prefix_length(n: int, threshold: tuple[int, int]) -> int:
    return n - -(-threshold[0] * n // threshold[1]) + 1 if n else 0


def sketch_bits_of(docs: DataFrame) -> int:
    """Bits for a sketch of these texts, by the planner's estimate of their size."""
    least, most = SKETCH_BITS
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(least, (size // CELL_BYTES).bit_length()), most)


def _pack(cells: np.ndarray) -> bytes:
    """Counts as compressed integers of the smallest size."""
    kind = np.min_scalar_type(int(cells.max()))
    return bytes([kind.itemsize]) + zlib.compress(cells.astype(kind).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), f"u{packed[0]}")


def _sketch(docs: DataFrame, text: str, k: int, bits: int) -> np.ndarray:
    """Six times the logarithm of the number of documents with a shingle in each of 2**bits cells. Every task of the scan
    counts into cells of its own and sends them as BLOCKS packed arrays, which are added up in three steps of at most
    some hundred arrays a group, for up to millions of tasks."""
    size, shift = 1 << bits, np.uint64(64 - bits)
    blocks = min(BLOCKS, size)

    def count(batches):
        cells = np.zeros(size, np.uint32)
        for batch in batches:
            for one in shingle_sets(batch.column(0), k):
                np.add.at(cells, (one >> shift).astype(np.int64), np.uint32(1))
        task = TaskContext.get().partitionId()
        for i, part in enumerate(cells.reshape(blocks, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([task], pa.int32()), pa.array([_pack(part)], pa.binary())], names=["block", "task", "cells"])

    def add(key, table):
        total = np.zeros(size // blocks, np.int64)
        for x in table["cells"]:
            total += _unpack(x.as_py())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int32()), "cells": pa.array([_pack(total)], pa.binary())})

    found = docs.select(text).mapInArrow(count, "block int, task int, cells binary")
    for _ in range(3):
        found = found.withColumn("task", F.expr("cast(task div 128 as int)")).groupBy("block", "task").applyInArrow(add, "block int, task int, cells binary")
    out = np.zeros((blocks, size // blocks), np.uint8)
    for r in found.collect():  # BLOCKS rows, for up to 128 ** 3 tasks
        out[r.block] = np.minimum(np.ceil(6 * np.log2(_unpack(bytes(r.cells)) + 1.0)), 255)
    return out.ravel()


def _prefix(one: np.ndarray, order: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    p = prefix_length(len(one), threshold)
    return one[np.argpartition(order, p - 1)[:p]] if p < len(one) else one


def _rare_first(one: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    return (sketch[(one >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (W.mix(one) >> np.uint64(8))


def _buckets(one: np.ndarray) -> np.ndarray:
    """Numbers of shingles in a power of two of buckets, 12 to 24 a bucket on average for all but small sets."""
    size = max(16, 1 << max(0, (len(one) // 12).bit_length() - 1))
    return np.bincount((W.mix(one + np.uint64(1)) & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint32)


def _allowed(signs: list[np.ndarray], n: np.ndarray, left: np.ndarray, across: bool, threshold: tuple[int, int]) -> np.ndarray:
    """Whether each member has a partner whose signature allows a link."""
    t, u = threshold
    out = np.zeros(len(signs), bool)
    width = np.array([len(x) for x in signs])
    full = {w: np.stack([signs[i] for i in np.flatnonzero(width == w)]) for w in np.unique(width).tolist()}
    for w, rows in full.items():
        at = np.flatnonzero(width == w)
        for w2 in (x for x in full if x >= w):
            at2 = np.flatnonzero(width == w2)
            rows2 = full[w2].reshape(len(at2), w2 // w, w).sum(1)
            for k, i in enumerate(at.tolist()):
                fit = np.minimum(n[at2], n[i]) * u >= np.maximum(n[at2], n[i]) * t
                fit &= at2 != i
                if across:
                    fit &= left[at2] != left[i]
                some = np.flatnonzero(fit)
                if len(some):
                    most = np.minimum(rows2[some], rows[k]).sum(1)
                    good = at2[some[(t + u) * most >= t * (n[at2[some]] + n[i])]]
                    if len(good):
                        out[i] = True
                        out[good] = True
    return out


def _sift(members: DataFrame, threshold) -> DataFrame:
    def sift(key, table):
        signs = [np.frombuffer(x, np.uint32) for x in table["sig"].to_pylist()]
        keep = _allowed(signs, table["n"].to_numpy(), np.array(table["left"].to_pylist()), key[2].as_py(), threshold)
        return table.drop_columns(["sig"]).filter(pa.array(keep))

    return members.groupBy("c1", "c2", "across", "hot").applyInArrow(sift, "doc long, c1 long, c2 long, across boolean, left boolean, hot boolean, n long")


def _rounds(tiles: DataFrame, total: int, most: int) -> list[DataFrame]:
    """Rows with c1 and c2, dealt by tile into rounds, as many as a total needs of which a round takes `most`."""
    n = max(1, -(-total // most))
    place = F.pmod(F.xxhash64(F.lit("round"), "c1", "c2"), F.lit(n))
    return [tiles.where(place == i) if n > 1 else tiles for i in range(n)]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def _signatures(docs: DataFrame, doc_id: str, text: str, k: int, threshold, sketch, bits: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def sign(batches):
        for batch in batches:
            n, h1, h2, tokens, signs = [], [], [], [], []
            for one in shingle_sets(batch.column(1), k):
                n.append(len(one))
                h1.append(int(np.add.reduce(W.mix(one))))
                h2.append(int(np.add.reduce(W.mix(one ^ np.uint64(0xA5A5A5A5DEADBEEF)))))
                tokens.append(_prefix(one, _rare_first(one, sent.value, bits), threshold).view(np.int64))
                signs.append(_buckets(one).tobytes())
            u = lambda x: pa.array(W.mix(np.array(x, np.uint64)).view(np.int64))
            cuts = np.zeros(len(tokens) + 1, np.int32)
            np.cumsum([len(x) for x in tokens], out=cuts[1:])
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), u(h1), u(h2), lists, pa.array(signs, pa.binary())], names=["doc", "n", "h1", "h2", "tokens", "sig"])

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(sign, "doc long, n long, h1 long, h2 long, tokens array<long>, sig binary")


def _candidates(ratio: tuple[int, int], most: int):
    """A pass over rows (token, h1, n) sorted by token and h1. A token of 2 to `most` classes gives the pairs of
    classes whose sizes fit; one of more gives rows (token, class, leader), its leader the smallest class. No
    more than the rows of one undecided token are held from batch to batch."""
    t, u = ratio
    names = ["token", "a", "b", "na", "nb"]

    def rows(token, a, b, na, nb):
        token = pa.nulls(len(a), pa.int64()) if token is None else pa.array(token)
        return pa.RecordBatch.from_arrays([token, pa.array(a), pa.array(b), pa.array(na), pa.array(nb)], names=names)

    def pairs(h1, n, first, size):
        parts = []
        for k in np.unique(size).tolist():
            if 2 <= k <= most:
                at = first[size == k][:, None]
                i, j = np.triu_indices(k, 1)
                parts.append(np.stack([(at + i).ravel(), (at + j).ravel()]))
        if parts:
            i, j = np.concatenate(parts, 1)
            fit = np.minimum(n[i], n[j]) * u >= np.maximum(n[i], n[j]) * t
            i, j = i[fit], j[fit]
            order = np.lexsort((h1[j], h1[i]))
            i, j = i[order], j[order]
            new = np.ones(len(i), bool)
            new[1:] = (h1[i[1:]] != h1[i[:-1]]) | (h1[j[1:]] != h1[j[:-1]])
            i, j = i[new], j[new]
            yield rows(None, h1[i], h1[j], n[i], n[j])

    def frequent(token, h1, n, leader):
        return rows(token, h1, leader, n, n)

    def scan(batches):
        held = [np.zeros(0, np.int64)] * 3
        hot = None  # token, leader and last class of a frequent token whose rows still come
        for batch in batches:
            part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            token, h1, n = (np.append(x, y) for x, y in zip(held, part, strict=True))
            keep = np.ones(len(token), bool)
            keep[1:] = (token[1:] != token[:-1]) | (h1[1:] != h1[:-1])
            if hot and len(token) and token[0] == hot[0] and h1[0] == hot[2]:
                keep[0] = False
            token, h1, n = token[keep], h1[keep], n[keep]
            if hot and len(token):
                k = int(np.searchsorted(token, hot[0], "right")) if token[0] == hot[0] else 0
                if k:
                    yield frequent(token[:k], h1[:k], n[:k], np.full(k, hot[1]))
                    hot = (hot[0], hot[1], h1[k - 1])
                    token, h1, n = token[k:], h1[k:], n[k:]
                if len(token):
                    hot = None
            if not len(token):
                held = [np.zeros(0, np.int64)] * 3
                continue
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(first, len(token)))
            if size[-1] > most:
                hot = (token[-1], h1[first[-1]], h1[-1])
                held = [np.zeros(0, np.int64)] * 3
            else:
                held = [x[first[-1] :] for x in (token, h1, n)]
                first, size = first[:-1], size[:-1]
            for i, k in zip(first[size > most].tolist(), size[size > most].tolist(), strict=True):
                yield frequent(token[i : i + k], h1[i : i + k], n[i : i + k], np.full(k, h1[i]))
            yield from pairs(h1, n, first, size)
        yield from pairs(held[1], held[2], np.zeros(1, np.int64), np.array([len(held[1])]))

    return scan


def _chunks(follows: DataFrame, docs: int, shingles: int) -> DataFrame:
    """h1, leader, n, chunks, chunk from h1, leader, n: each leader's followers, dealt out by hash into chunks of
    bounded size. A chunk's name is a hash of the leader and of the place among its chunks."""
    follows = follows.groupBy("h1").agg(F.min("leader").alias("leader"), F.max("n").alias("n"))
    sizes = follows.groupBy("leader").agg(_number(docs, shingles).alias("chunks"))
    return follows.join(sizes, "leader").select("h1", "leader", "n", "chunks", F.xxhash64("leader", F.pmod(F.xxhash64("h1"), F.col("chunks"))).alias("chunk"))


def _number(docs: int, shingles: int):
    return F.greatest(F.ceil(F.count("*") / docs), F.ceil(F.sum("n") / shingles))


def _anew(close: DataFrame, known: DataFrame, docs: int, shingles: int) -> DataFrame:
    """h1, chunk, tag, several of followers (close, with the component of each from known: h1, component): of a leader
    with several chunks, components of half a chunk or more get chunks of their own, with the component as tag; other
    followers share chunks without one. `several`: the leader has several chunks."""
    rows = close.join(known, "h1").select("h1", "leader", "n", "component", (F.col("chunks") > 1).alias("several"))
    sizes = rows.where("several").groupBy("leader", "component").agg(_number(docs, shingles).alias("some"), F.count("*").alias("count"), F.sum("n").alias("total"))
    own = sizes.where((F.col("count") * 2 >= docs) | (F.col("total") * 2 >= shingles)).select("leader", "component", F.col("some").alias("chunks"))
    tagged = rows.join(own, ["leader", "component"])
    rest = rows.join(own.select("leader", "component"), ["leader", "component"], "left_anti")
    left = rest.groupBy("leader").agg(_number(docs, shingles).alias("chunks"))
    rest = rest.join(left, "leader")
    place = F.pmod(F.xxhash64("h1"), F.col("chunks"))
    return tagged.select("h1", F.xxhash64("leader", "component", place).alias("chunk"), F.col("component").alias("tag"), "several").union(
        rest.select("h1", F.xxhash64("leader", F.lit("rest"), place), F.lit(None).cast("long"), "several")
    )


def _meeting(seen: DataFrame) -> DataFrame:
    """c1, c2 of all chunks that share a shingle, from token, chunk, tag, several: not of two chunks of one tag, nor of a
    chunk with itself where its leader has no other."""
    end = lambda df, x: df.select("token", F.col("chunk").alias(f"c{x}"), F.col("tag").alias(f"tag{x}"), F.col("several").alias(f"several{x}"))
    rest, own = seen.where("tag is null"), seen.where("tag is not null")
    # Tagged chunks meet only at shingles of several tags.
    mixed = own.groupBy("token").agg(F.min("tag").alias("low"), F.max("tag").alias("high")).where("low <> high").select("token")
    apart = own.join(mixed, "token", "left_semi")
    both = end(rest, 1).join(end(rest, 2), "token").where("c1 < c2 or c1 = c2 and several1")
    across = end(rest, 1).join(end(own, 2), "token")
    tags = end(apart, 1).join(end(apart, 2), "token").where("c1 < c2 and tag1 <> tag2")
    pairs = both.select("c1", "c2").union(across.select("c1", "c2")).union(tags.select("c1", "c2"))
    return pairs.select(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2")).distinct()


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


class _Index:
    """Lists of members by token, to count at once how many tokens one member shares with all others."""

    def __init__(self, lists: list[np.ndarray]):
        self.owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        tokens = np.concatenate(lists)
        order = np.argsort(tokens, kind="stable")
        self.owner, tokens = self.owner[order], tokens[order]
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        self.begin = np.append(np.flatnonzero(new), len(tokens))
        # position of each list's tokens among the distinct ones
        rank = np.empty(len(tokens), np.int64)
        rank[order] = np.cumsum(new) - 1
        self.cuts = np.append(0, np.cumsum([len(x) for x in lists]))
        self.rank = rank

    def shared(self, i: int, n: int) -> np.ndarray:
        at = self.rank[self.cuts[i] : self.cuts[i + 1]]
        first, size = self.begin[at], self.begin[at + 1] - self.begin[at]
        total = int(size.sum())
        flat = np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(total)
        return np.bincount(self.owner[flat], minlength=n)


def forest(sets: list[np.ndarray], left: np.ndarray, across: bool, prefixes: list[list[np.ndarray]], threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning forest of the links among these sets; with `across`, of those between left and the rest."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    indexes = [_Index(x) for x in prefixes]
    whole = None
    tree, out = _Forest(n), []
    for i in range(n):
        ok = (np.minimum(size, size[i]) * threshold[1] >= np.maximum(size, size[i]) * threshold[0]) & (size > 0)
        ok[: i + 1] = False
        if across:
            ok &= left != left[i]
        for index in indexes:
            if not ok.any():
                break
            ok &= index.shared(i, n) > 0
        if not ok.any():
            continue
        near = [j for j in np.flatnonzero(ok).tolist() if tree.root(j) != tree.root(i)]
        if not near:
            continue
        if len(near) <= 8:
            common = {j: len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in near}
        else:
            whole = whole or _Index(sets)
            common = whole.shared(i, n)
        for j in near:
            both = int(common[j])
            if both * threshold[1] >= (int(size[i]) + int(size[j]) - both) * threshold[0] and (a := tree.root(i)) != (b := tree.root(j)):
                tree.up[b] = a
                out.append((i, j))
    return out


def _links(members: DataFrame, k: int, threshold, sketch, bits: int) -> DataFrame:
    """members: tile (two chunks, whether they differ, kind), left, doc, text. Returns the links each tile finds."""
    sent = members.sparkSession.sparkContext.broadcast(sketch)

    def verify(key, table):
        docs, left = table["doc"].to_pylist(), table["left"].to_pylist()
        order = sorted(range(len(docs)), key=lambda i: (docs[i], left[i]))
        sets = list(shingle_sets(table["text"], k))
        sets = [sets[i] for i in order]
        docs, left = [docs[i] for i in order], np.array([left[i] for i in order])
        orders = [[_prefix(x, _rare_first(x, sent.value, bits), threshold) for x in sets]]
        orders += [[_prefix(x, W.mix(x ^ o), threshold) for x in sets] for o in _ORDERS]
        found = forest(sets, left, key[2].as_py(), orders, threshold)
        return pa.table({"a": pa.array([docs[i] for i, _ in found], pa.int64()), "b": pa.array([docs[j] for _, j in found], pa.int64())})

    return members.groupBy("c1", "c2", "across", "hot").applyInArrow(verify, "a long, b long")


def components(links: DataFrame, *, most: int = 60) -> DataFrame:
    """node, component: the smallest node connected with each node of the links (a, b), by alternating
    large-star and small-star steps; each round is written to the shared folder."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, last = written(edges, "edges"), None
    for _ in range(most):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = written(small, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _bloom_filters(spark: SparkSession):
    """Lets Spark use runtime Bloom filters whatever the size of the filtered side."""
    return _setting(spark, "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")


def _shuffles_dropped(spark: SparkSession):
    """Lets Spark remove the shuffle files of each job when it ends, not when the driver collects its garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def _linked(docs: DataFrame, doc_id: str, text: str, k: int, threshold, sketch_bits: int | None, chunk_docs: int, chunk_shingles: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of signatures, classes, and components of the classes' smallest documents."""
    small_batches(docs.sparkSession)
    sketch_bits = sketch_bits or sketch_bits_of(docs.select(text))
    sketch = _sketch(docs, text, k, sketch_bits)
    signed = written(_signatures(docs, doc_id, text, k, threshold, sketch, sketch_bits), "signatures")
    known = signed.where("doc is not null and n > 0")
    classes = written(known.groupBy("h1", "h2").agg(F.min("doc").alias("rep"), F.max("n").alias("n"), F.max("sig").alias("sig")), "classes")

    posts = known.select(F.explode("tokens").alias("token"), "h1", "n")
    found = written(posts.repartition("token").sortWithinPartitions("token", "h1").mapInArrow(_candidates(threshold, PAIRED), "token long, a long, b long, na long, nb long"), "candidates")
    pairs = written(found.where("token is null").select("a", "b", "na", "nb").distinct(), "pairs")
    frequent = found.where("token is not null").select("token", F.col("a").alias("h1"), F.col("b").alias("leader"), F.col("na").alias("n"))

    both = F.array(F.struct(F.col("a").alias("h1"), F.col("na").alias("n")), F.struct(F.col("b").alias("h1"), F.col("nb").alias("n")))
    dealt = written(_chunks(pairs.select(F.col("a").alias("leader"), F.explode(both).alias("e")).select("e.h1", "e.n", "leader"), chunk_docs, chunk_shingles), "chunks")
    at = lambda x: dealt.select(F.col("h1").alias(x), F.col("chunk").alias(f"chunk_{x}"))
    placed = pairs.select("a", "b").join(at("a"), "a").join(at("b"), "b").select("a", "b", F.least("chunk_a", "chunk_b").alias("c1"), F.greatest("chunk_a", "chunk_b").alias("c2"), (F.col("chunk_a") <= F.col("chunk_b")).alias("straight"))
    ends = F.array(F.struct(F.col("a").alias("h1"), F.col("straight").alias("left")), F.struct(F.col("b").alias("h1"), (~F.col("straight")).alias("left")))
    # Inside one chunk the side says nothing.
    paired = placed.select("c1", "c2", F.explode(ends).alias("e")).select("e.h1", "c1", "c2", (F.col("e.left") | (F.col("c1") == F.col("c2"))).alias("left"), F.lit(False).alias("hot")).distinct()

    close = written(_chunks(frequent.select("h1", "leader", "n"), chunk_docs, chunk_shingles), "close")
    inside = lambda df: df.select("h1", F.col("chunk").alias("c1"), F.col("chunk").alias("c2"), F.lit(True).alias("left"), F.lit(True).alias("hot"))
    pivots = close.where("chunks > 1").groupBy("leader", F.pmod(F.xxhash64(F.lit("pivot"), "h1"), F.lit(PIVOTS))).agg(F.min("h1").alias("h1")).select("leader", "h1")
    met = close.where("chunks > 1").select("leader", "chunk").distinct().join(pivots, "leader")
    alone = inside(close.select("h1", "chunk").union(met.select("h1", "chunk")).distinct())

    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))

    whole = classes.agg(F.count("*").alias("count"), F.sum(F.length("sig")).alias("signs"), F.sum("n").alias("n")).first()
    signs, shingles = whole.signs or 0, whole.n or 0

    def links_of(rounds: list[DataFrame]) -> DataFrame:
        """rounds: c1, c2, left, hot, rep, n, sig of the members of tiles."""
        wanted = []
        for members in rounds:
            members = members.select(F.col("rep").alias("doc"), "c1", "c2", (F.col("c1") != F.col("c2")).alias("across"), "left", "hot", "n", "sig")
            wanted.append(written(_sift(members, threshold), "members"))
        wanted = _union(wanted)
        sent = wanted.agg(F.sum("n")).first()[0] or 0
        links = []
        for some in _rounds(wanted.drop("n"), sent, max(ROUND_TEXTS * shingles, LEAST_ROUND)):
            # Chunks are ordered, so the condition always holds; with it Spark may send a Bloom filter of the members to
            # the scan of the texts, so that the texts of other documents are not shuffled.
            members = texts.join(some.where("c1 <= c2"), "doc")
            with _bloom_filters(docs.sparkSession):
                links.append(written(_links(members, k, threshold, sketch, sketch_bits), "links"))
        return _union(links)

    most = max(ROUND_SIGNS * signs, LEAST_ROUND)
    placed = written(paired.union(alone), "placed")
    sent = placed.count() * signs // max(1, whole["count"])
    links = links_of([some.join(classes, "h1") for some in _rounds(placed, sent, most)])
    found = components(links)
    known = classes.select("h1", "rep").join(found, F.col("rep") == F.col("node"), "left").select("h1", F.coalesce("component", "rep").alias("component"))
    anew = written(_anew(close, known, chunk_docs, chunk_shingles), "anew")
    seen = written(frequent.select("token", "h1").join(anew, "h1").select("token", "chunk", "tag", "several").distinct(), "seen")
    tiles = written(_meeting(seen), "tiles")
    if not tiles.isEmpty():
        sides = F.when(F.col("c1") == F.col("c2"), F.array(F.struct(F.col("c1").alias("chunk"), F.lit(True).alias("left")))).otherwise(F.array(F.struct(F.col("c1").alias("chunk"), F.lit(True).alias("left")), F.struct(F.col("c2").alias("chunk"), F.lit(False).alias("left"))))
        sides = tiles.select("c1", "c2", F.explode(sides).alias("e")).select("e.chunk", "c1", "c2", "e.left", F.lit(True).alias("hot"))
        filled = written(anew.select("h1", "chunk").join(classes, "h1").select("chunk", "rep", "n", "sig"), "filled")
        sent = sides.join(filled.groupBy("chunk").agg(F.sum(F.length("sig")).alias("signs")), "chunk").agg(F.sum("signs")).first()[0] or 0
        more = links_of([some.join(filled, "chunk") for some in _rounds(sides, sent, most)])
        if not more.isEmpty():
            # Components found so far are links of their members.
            found = components(more.union(found.select("node", "component")))
    return signed, classes, found


def link_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K, threshold: tuple[int, int] = THRESHOLD, sketch_bits: int | None = None, chunk_docs: int = CHUNK_DOCS, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set) and component_id of every row."""
    with _shuffles_dropped(docs.sparkSession):
        signed, classes, found = _linked(docs, doc_id, text, k, threshold, sketch_bits, chunk_docs, chunk_shingles)
    labelled = classes.join(found, classes.rep == found.node, "left").select("h1", "h2", "rep", F.coalesce("component", "rep").alias("component"))
    out = signed.where("n > 0").join(labelled, ["h1", "h2"], "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.col("rep")).alias("class_id"), F.when(F.col("doc").isNotNull(), F.col("component")).alias("component_id"))
    return out.union(signed.where("n = 0").select("doc", "n", "doc", "doc"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without those whose component has a smaller doc_id; rows with a null doc_id stay, and of rows that
    repeat a doc_id all stay."""
    with last_kept():
        found = link_classes(docs, **options).where("component_id <> doc_id").select(F.col("doc_id").alias("_td_gone")).distinct()
        with _shuffles_dropped(docs.sparkSession):
            gone = written(found, "gone")
    return docs.join(gone, docs[options.get("doc_id", "doc_id")] == gone["_td_gone"], "left_anti")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return link_classes(docs).select("doc_id", "n_shingles", "component_id")
