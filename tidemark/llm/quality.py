"""Quality rules: base counts of a text, then a linear-chain conditional random field over its lines.

Every line with a word is an observation; the field's two labels are content and boilerplate. Viterbi
decoding finds the best label sequence of the whole text, and the share of words in content lines decides
whether the text is kept.

The field is trained here, from document labels (quality 0 or 1); lines have no labels of their own. First lines are
told apart one by one: a document's label is evidence on each of its lines, right with probability `TRUST`, and a
logistic model of the lines' features maximises the likelihood of the evidence. A line's label then is a probability
given its features and the evidence, so lines of a poor document that look like those of good ones are mostly content,
and the other way round. On these labels the field's weights and transitions maximise the regularised conditional
likelihood, by forward-backward over all sampled lines at once: transitions are learned from inside documents.

The sample: at most `max_docs` labelled documents, half of each label, the smallest hashes of their ids; of a document
of more than `max_lines` lines that many consecutive ones, from a place given by the hash. Texts are measured whole
on executors, and only the lines' features travel.

Defined cases: null text has no words (base_failed, not kept); empty texts likewise; rows are judged one by
one, so repeated rows agree, and of rows that repeat an id in training one is learned from; a document labelled both
ways is not learned from; without documents of both labels the field is none and keeps everything that does not fail;
between equally good label sequences the one with boilerplate at the last line where they differ is taken; texts of
any length are judged whole; columns of the input that bear the names of results are replaced, others pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as W
from ._shared import small_batches

MAX_DOCS = 3000
MAX_LINES = 200
#: How far a document's label is trusted for one of its lines.
TRUST = 0.8
MIN_SHARE = (1, 2)
MIN_WORDS = 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NOT_NEWLINE = ~W.table((10, 10))
_CHAR = ~W.table((0x80, 0xBF))  # one byte of each code point
_UPPER, _ALPHA, _DIGIT = W.table((65, 90)), W.table((65, 90), (97, 122), (0x80, 0xFF)), W.table((48, 57))
_MARK = W.table((33, 33), (63, 63), (124, 124))
_END = W.table((46, 46), (33, 33), (63, 63))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = 14


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _again(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (row, key): whether it occurs elsewhere in the row, and whether it did before."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    mixed = W.mix(keys + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(mixed, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = mixed[order][1:] == mixed[order][:-1]
    several, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    several[order], before[order] = same[1:] | same[:-1], same[:-1]
    return several, before


@dataclass
class Lines:
    counts: np.ndarray  # rows by COUNTS
    cuts: np.ndarray  # of each row's lines
    words: np.ndarray  # of each line
    features: np.ndarray  # of each line


def measure(data: np.ndarray, offsets: np.ndarray) -> Lines:
    n = len(offsets) - 1
    starts, ends, rows = W.spans(data, offsets, W.SPACED)
    hashes = W.span_hash(data, starts, ends)
    chars = _sums(_CHAR[data])
    counts = np.zeros((n, len(COUNTS)), np.int64)
    counts[:, 0] = np.bincount(rows, minlength=n)
    counts[:, 1] = np.bincount(rows, chars[ends] - chars[starts], minlength=n)
    symbols = _sums(_SYMBOL[data])
    counts[:, 2] = symbols[offsets[1:]] - symbols[offsets[:-1]]

    three, at = W.runs(hashes, rows, 3)
    several, _ = _again(three, rows[at])
    repeated = np.zeros(len(starts), bool)
    for j in range(3):
        repeated[at[several] + j] = True
    counts[:, 4] = np.bincount(rows[repeated], minlength=n)

    begins, stops, line_rows = W.spans(data, offsets, _NOT_NEWLINE)
    first = np.searchsorted(starts, begins)
    n_words = np.searchsorted(starts, stops) - first
    has = n_words > 0
    begins, stops, line_rows, n_words, first = begins[has], stops[has], line_rows[has], n_words[has], first[has]
    _, before = _again(W.span_hash(data, begins, stops), line_rows)
    counts[:, 3] = np.bincount(line_rows[before], minlength=n)

    per = lambda flags: (s := _sums(flags))[stops] - s[begins]
    length = np.maximum(stops - begins, 1)
    letters = np.maximum(per(_ALPHA[data]), 1)
    rep = _sums(repeated)
    share = (rep[first + n_words] - rep[first]) / n_words
    symbol, upper, digit, mark = per(_SYMBOL[data]) / n_words, per(_UPPER[data]) / letters, per(_DIGIT[data]) / length, per(_MARK[data]) / n_words
    features = np.stack([np.ones(len(begins)), n_words < 4, n_words < 12, n_words > 60, symbol > 0.1, symbol > 0.5, upper > 0.3, upper > 0.7, digit > 0.15, mark > 0.3, before, share > 0.2, share > 0.6, _END[data[np.maximum(stops - 1, 0)]] if len(stops) else np.zeros(0)], 1).astype(float)
    return Lines(counts, W.bounds(line_rows, n), n_words, features)


@dataclass
class Field:
    weights: np.ndarray  # of each feature, for content against boilerplate
    move: np.ndarray  # 2 by 2: from label to label


@dataclass
class Sample:
    """Lines of the documents learned from, one after the other, longest documents first."""

    features: np.ndarray  # of each line
    first: np.ndarray  # line of each document
    size: np.ndarray
    quality: np.ndarray  # of each document, 0 or 1

    @classmethod
    def of(cls, parts: list[np.ndarray], quality: list[int]) -> Sample:
        order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        size = np.array([len(parts[i]) for i in order])
        return cls(np.concatenate([parts[i] for i in order]).astype(float), np.append(0, np.cumsum(size)[:-1]), size, np.array([quality[i] for i in order]))


def _balance(sample: Sample) -> tuple[np.ndarray, np.ndarray]:
    """Document of each line, and weights of lines by which both document labels count alike."""
    rows = np.repeat(np.arange(len(sample.size)), sample.size)
    share = np.bincount(sample.quality[rows], minlength=2) / max(len(rows), 1)
    return rows, (0.5 / np.maximum(share, 1e-9))[sample.quality[rows]]


def evidence(weights: np.ndarray, sample: Sample, trust: float = TRUST, prior: float = 1e-3) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log-likelihood a line of the documents' labels, less the prior, its gradient, and each line's probability
    of content given its features and its document's label."""
    rows, w = _balance(sample)
    p = 1 / (1 + np.exp(-(sample.features @ weights)))
    good = np.where(sample.quality[rows] == 1, trust, 1 - trust)
    seen = p * good + (1 - p) * (1 - good)
    content = p * good / seen
    grad = sample.features.T @ (w * (content - p)) / w.sum() - prior * weights
    return float((w * np.log(seen)).sum() / w.sum() - prior / 2 * (weights**2).sum()), grad, content


def likelihood(parameters: np.ndarray, sample: Sample, content: np.ndarray, prior: float = 1e-3) -> tuple[float, np.ndarray]:
    """Mean log-likelihood a line of the field, less the prior, and its gradient. content: each line's probability
    of content; parameters: the features' weights, then the transitions by rows."""
    x, first, size = sample.features, sample.first, sample.size
    weights, move = parameters[:FEATURES], parameters[FEATURES:].reshape(2, 2)
    rows, w = _balance(sample)
    step, score = np.exp(move), x @ weights
    # Potentials of both labels; the greater one is 1.
    top = np.maximum(score, 0)
    e = np.exp(np.stack([-top, score - top], 1))
    ahead, scale, back = np.zeros_like(e), np.zeros(len(e)), np.ones_like(e)
    active = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), "right")
    for t, k in enumerate(active.tolist()):
        at = first[:k] + t
        a = e[at] * (ahead[at - 1] @ step if t else 1)
        scale[at] = a.sum(1)
        ahead[at] = a / scale[at][:, None]
    for t in range(len(active) - 1, 0, -1):
        at = first[: active[t]] + t
        back[at - 1] = (e[at] * back[at] / scale[at][:, None]) @ step.T
    inner = np.ones(len(x), bool)
    inner[first[size > 0]] = False
    at = np.flatnonzero(inner)
    told = np.stack([1 - content, content], 1)
    pairs = told[at - 1][:, :, None] * told[at][:, None, :]
    free = ahead[at - 1][:, :, None] * step * (e[at] * back[at] / scale[at][:, None])[:, None, :]
    grad = np.append(x.T @ (w * (content - (ahead * back)[:, 1])), (w[at][:, None, None] * (pairs - free)).sum(0))
    # A document's lines all have its weight.
    value = (w * (content * score - np.log(scale) - top)).sum() + (w[at][:, None, None] * pairs * move).sum()
    n = w.sum()
    return float(value / n - prior / 2 * (parameters**2).sum()), grad / n - prior * parameters


def _climb(gradient, size: int, rounds: int, rate: float) -> np.ndarray:
    """Adam, from 0."""
    out = m = v = np.zeros(size)
    for step in range(1, rounds + 1):
        grad = gradient(out)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        out = out + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return out


def fit(sample: Sample, *, rounds: int = 150, rate: float = 0.1, trust: float = TRUST, prior: float = 1e-3) -> Field:
    alone = _climb(lambda p: evidence(p, sample, trust, prior)[1], FEATURES, rounds, rate)
    content = evidence(alone, sample, trust, prior)[2]
    found = _climb(lambda p: likelihood(p, sample, content, prior)[1], FEATURES + 4, rounds, rate)
    return Field(found[:FEATURES], found[FEATURES:].reshape(2, 2))


def viterbi(lines: Lines, field: Field) -> np.ndarray:
    """Whether each line is content in the best label sequence of its text."""
    size = np.diff(lines.cuts)
    order = np.argsort(-size, kind="stable")
    score = lines.features @ field.weights
    best = np.zeros((len(size), 2))
    back = np.zeros((len(score), 2), bool)
    out = np.zeros(len(score), bool)
    first = lines.cuts[:-1][order]
    size = size[order]
    active = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), "right")
    for t, k in enumerate(active.tolist()):
        at = first[:k] + t
        if t:
            stay, come = best[:k, :1] + field.move[0], best[:k, 1:] + field.move[1]
            back[at] = come > stay
            best[:k] = np.maximum(stay, come)
        best[:k, 1] += score[at]
    state = best[:, 1] > best[:, 0]
    for t in range(len(active) - 1, -1, -1):
        k = int(active[t])
        at = first[:k] + t
        out[at] = state[:k]
        if t:
            state[:k] = back[at, state[:k].astype(int)]
    return out


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> Field | None:
    """A field from at most max_docs labelled documents and max_lines lines of each; None without both labels."""
    small_batches(docs.sparkSession)
    wanted = labels.where(F.col(doc_id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("i")).agg(F.max(F.col(quality) != 0).alias("q"), F.min(F.col(quality) != 0).alias("q0")).where("q = q0")
    wanted = wanted.select("i", "q", F.xxhash64(F.col("i").cast("string"), F.lit("quality")).alias("h"))
    chosen = wanted.where("q").orderBy("h", "i").limit(max_docs // 2).union(wanted.where("not q").orderBy("h", "i").limit(max_docs // 2))

    def lines(batches):
        for batch in batches:
            found = []
            for first, end, data, offsets in W.slices(batch.column(1)):
                measured = measure(data, offsets)
                for i in range(end - first):
                    a, b = int(measured.cuts[i]), int(measured.cuts[i + 1])
                    if b - a > max_lines:
                        a += batch.column(3)[first + i].as_py() % (b - a - max_lines + 1)
                        b = a + max_lines
                    found.append(measured.features[a:b].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(found, pa.binary())], names=["i", "q", "lines"])

    # At most max_docs rows, so broadcasting them is bounded.
    texts = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(chosen), "i").select("i", "t", "q", "h")
    found = texts.mapInArrow(lines, "i string, q boolean, lines binary").where(F.length("lines") > 0)
    rows = found.groupBy("i").agg(F.max("q").alias("q"), F.max("lines").alias("lines")).orderBy("i").collect()
    if len({r.q for r in rows}) < 2:
        return None
    return fit(Sample.of([np.frombuffer(r.lines, np.uint8).reshape(-1, FEATURES) for r in rows], [int(r.q) for r in rows]))


def judge(docs: DataFrame, field: Field | None, *, text: str = "text", min_share: tuple[int, int] = MIN_SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the base counts, base_failed, content_share (of words) and kept."""
    small_batches(docs.sparkSession)
    names = [*COUNTS, "base_failed", "content_share", "kept"]
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def rate(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            counts, share = np.zeros((len(column), len(COUNTS)), np.int64), np.ones(len(column))
            for first, end, data, offsets in W.slices(column):
                lines = measure(data, offsets)
                counts[first:end] = lines.counts
                if sent.value is not None:
                    rows = np.repeat(np.arange(end - first), np.diff(lines.cuts))
                    good = np.bincount(rows, lines.words * viterbi(lines, sent.value), minlength=end - first)
                    share[first:end] = good / np.maximum(lines.counts[:, 0], 1)
            failed = (counts[:, 0] < min_words) | (100 * counts[:, 4] > 50 * counts[:, 0])
            kept = ~failed & (share * min_share[1] >= min_share[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(counts[:, i]) for i in range(len(COUNTS))], pa.array(failed), pa.array(share), pa.array(kept)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(rate, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, field).drop("text")
