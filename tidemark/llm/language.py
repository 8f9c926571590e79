"""Language identification by a string kernel.

A text's features are the presence of its n-grams of 1 to 3 symbols (a blended spectrum). Symbols are classes
of UTF-8 bytes: letters a-z without case, one symbol for every run of other ASCII characters, and 32 symbols
for the bytes of non-ASCII characters (Latin-1 capitals are lowered first). The kernel of two texts is the
number of n-grams present in both over the square root of the product of their numbers of distinct n-grams, those that
no landmark has among them.

Training: labelled rows are sampled by a hash of their id, equally for each language, at most `max_rows` in
all, or two a language where that is more; executors send each sampled row as a bit set of fixed size. The first of each language are Nystroem
landmarks, one a language at least. A one-versus-rest kernel ridge regression is solved in the landmarks' feature space. As the kernel
is linear in the presence bits, the landmarks and coefficients fold into one matrix (n-grams by languages), so
scoring a batch of whole texts is one product of its presence matrix with that matrix.

Defined cases: null text or text without any letter is `und` with score 0; without labelled rows every text
is, and a table without rows gives none; rows are predicted one by one, so repeated rows get the same prediction; of
languages with equal scores the first by name is taken; texts are read whole, a text of any length a stretch of symbols
at a time; extra columns pass through, but lang_pred, score and held_out are replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as W
from ._shared import small_batches

UNKNOWN = "und"
MAX_ROWS = 1200
LANDMARKS = 300
RIDGE = 1e-2
_SIZE = 64 + 64**2 + 64**3


def _symbols() -> np.ndarray:
    out = np.zeros(256, np.int32)
    for i in range(26):
        out[65 + i] = out[97 + i] = 1 + i
    for b in range(128, 256):
        out[b] = 27 + (b & 31)
    return out


_SYMBOL = _symbols().astype(np.uint8)


_STRETCH = 1 << 20


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all rows, runs of other characters as one, and the offsets of rows among them."""
    if not len(data):
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out = _SYMBOL[data + (capital * np.uint8(32)).astype(np.uint8)]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    keep[offsets[:-1][offsets[:-1] < len(out)]] = True
    return out[keep], np.append(0, np.cumsum(keep))[offsets]


def grams(sym: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams of each row of symbols (with repeats), and their rows."""
    sym = sym.astype(np.int32)
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    two, three = rows[1:] == rows[:-1], rows[2:] == rows[:-2]
    pair = sym[:-1] * 64 + sym[1:]
    triple = (pair[:-1] * 64 + sym[2:])[three]
    return np.concatenate([sym, pair[two] + 64, triple + 64 + 64**2]), np.concatenate([rows, rows[:-1][two], rows[:-2][three]])


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flags of the n-grams present in each row. Long rows are taken in stretches that share two symbols, so that no
    n-gram is missed."""
    sym, cuts = symbols(data, offsets)
    out = np.zeros((len(offsets) - 1, _SIZE), bool)
    if len(sym) <= _STRETCH:
        features, rows = grams(sym, cuts)
        out[rows, features] = True
        return out
    for row in range(len(out)):
        for at in range(int(cuts[row]), int(cuts[row + 1]), _STRETCH):
            part = sym[at : min(at + _STRETCH + 2, int(cuts[row + 1]))]
            out[row, grams(part, np.array([0, len(part)]))[0]] = True
    return out


@dataclass
class Model:
    languages: list[str]
    used: np.ndarray  # features that landmarks have
    weights: np.ndarray  # these features by languages
    bias: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray, group: int = 64) -> np.ndarray:
        n = len(offsets) - 1
        out = np.zeros((n, len(self.languages)), np.float32)
        for a in range(0, n, group):
            b = min(n, a + group)
            present = presence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            norm = np.sqrt(np.maximum(np.count_nonzero(present, 1), 1))[:, None]
            out[a:b] = (present[:, self.used].astype(np.float32) @ self.weights) / norm + self.bias
        return out


def fit(bits: list[bytes], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """bits: compressed presence bit sets, ordered so that any first part holds all languages about equally."""
    names = sorted(set(languages))
    bitset = lambda b: np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8))[:_SIZE]
    seen = np.zeros(_SIZE, bool)
    for b in bits[:landmarks]:
        seen |= bitset(b).astype(bool)
    used = np.flatnonzero(seen)

    def dense(some: list[bytes]) -> np.ndarray:
        x = [bitset(b) for b in some]
        return np.stack([b[used] / np.sqrt(max(int(b.sum()), 1)) for b in x]).astype(np.float32)

    marks = dense(bits[:landmarks])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = value > value[-1] * 1e-6
    root = vector[:, keep] / np.sqrt(value[keep])  # K_mm^(-1/2), up to a rotation
    phi = np.concatenate([dense(bits[i : i + 64]) @ marks.T for i in range(0, len(bits), 64)]) @ root
    y = np.array([[float(a == b) for b in names] for a in languages])
    bias = y.mean(0)
    coef = np.linalg.solve(phi.T @ phi + ridge * len(bits) / len(names) * np.eye(phi.shape[1]), phi.T @ (y - bias))
    return Model(names, used, (marks.T @ (root @ coef)).astype(np.float32), bias.astype(np.float32))


def train(rows: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """A model of all labels in rows. Counts of labels cover all rows; the texts learned from are a sample of at
    most max_rows rows, or of two rows a label where that is more, chosen by a hash of doc_id (of the text where it is null)."""
    small_batches(rows.sparkSession)
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    counts = {r.l: r["count"] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return None
    each = max(2, max_rows // len(counts))
    place = F.xxhash64(F.coalesce(F.col("i").cast("string"), F.col("t")), F.lit("sample")) / F.lit(2.0**64) + 0.5
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, min(1.0, max(1.3 * each, each + 25) / v))]), F.col("l"))
    sample = rows.withColumn("h", place).where(F.col("h") < share)

    def bits(batches):
        for batch in batches:
            packed = []
            for first, end, data, offsets in W.slices(batch.column(0)):
                for i in range(end - first):
                    flags = presence(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                    packed.append(zlib.compress(np.packbits(flags[0]).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(packed, pa.binary())], names=["l", "h", "b"])

    found = sample.select("t", "l", "h").mapInArrow(bits, "l string, h double, b binary").withColumn("at", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("at") <= each).orderBy("h").collect()
    by: dict[str, list[bytes]] = {}
    for row in found:
        if len(own := by.setdefault(row["l"], [])) < each:
            own.append(row["b"])
    mixed = [(b, name) for i in range(each) for name, own in sorted(by.items()) for b in own[i : i + 1]]
    return fit([b for b, _ in mixed], [name for _, name in mixed], max(landmarks, len(by)))


_LETTER = W.table((65, 90), (97, 122))


def lettered(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, offsets = W.buffers(column)
    sums = np.append(0, np.cumsum(_LETTER[data]))
    out = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])).tolist():
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predict(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (the softmax of the regressions' outputs)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def guess(batches):
        own = sent.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            names, score = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
            if own is not None:
                for first, end, data, offsets in W.slices(column):
                    s = own.scores(data, offsets).astype(np.float64)
                    p = np.exp(6 * (s - s.max(1, keepdims=True)))
                    best = s.argmax(1)
                    names[first:end] = np.array(own.languages, object)[best]
                    score[first:end] = (p / p.sum(1, keepdims=True))[np.arange(end - first), best]
                none = ~lettered(column)
                names[none], score[none] = UNKNOWN, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(guess, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(4)) == 2


def identify(docs: DataFrame, **options) -> DataFrame:
    """docs with held_out, lang_pred and score, by a model of the rows that are not held out."""
    doc_id = options.get("doc_id", "doc_id")
    model = train(docs.where(~held_out(doc_id)), **options)
    return predict(docs.drop("held_out").withColumn("held_out", held_out(doc_id)), model, text=options.get("text", "text"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
