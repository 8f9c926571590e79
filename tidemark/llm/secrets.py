"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

The base kinds are regular expressions. The method infers one stochastic automaton per kind from labelled
credentials. A credential is a sequence of symbols: the literal characters of a prefix that nearly all credentials of
the kind begin with, then classes of characters, with '+', '/', '_', '.', '=' and '-' as symbols of their own. The
prefix tree of these sequences is merged, in breadth-first order, where the outgoing frequencies of two states and of
all states below them are statistically compatible (Hoeffding's bound, as in ALERGIA). States seen fewer than
`LEAST_SEEN` times give no evidence and are never merged: what little is known of a rare kind stays as it was seen.
Of several partitions into classes, from fine to coarse, the one is taken whose automaton, inferred from half of the
credentials, gives the other half the greatest likelihood: so lengths and separators are learned where they are fixed
and loops where they are not. Characters beyond `DEPTH` are one last symbol with a distribution of their own.

Every token of a text outside base spans, of the length of the shortest credential learned from at least, is scored
by each automaton: the mean log-likelihood a character, relative to a background of all the corpus's characters. One
that reaches the threshold found on the credentials held out becomes a span of kind `format`. A token of digits
or letters alone passes only the automata of kinds with such a credential, as else every long number, rare as
digits are in the background, would resemble a hexadecimal credential.

Labelled credentials are the values of base spans in a sample of at most `max_labelled` distinct values a
kind, by a hash of the value. A value of the kind `assign` that is made of plain words (`token: next_page`) is not
plausible and not learned from; its base span is reported all the same.

Defined cases: null text is empty; rows are scanned one by one, so repeated rows agree; without labelled credentials
only base spans are reported; an empty table gives no rows; texts and tokens of any length are scanned whole; columns
with the names of results are replaced, others pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Hashable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as W
from ._shared import small_batches, written

#: The base kinds in their order, with their patterns and least lengths.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MIN_ASSIGN, _MIN_ACCESS = 6, 20
_NAMES = ("passw", "secret", "token", "api")  # one is in whatever _ASSIGN matches, once lowered
MAX_LABELLED = 400
ALPHA = 0.05
LEAST_SEEN = 30
DEPTH = 64
#: A prefix that this part of the credentials share is literal.
PREFIX_SHARE = 0.8
RESULTS = ("n_assign", "n_access", "n_hex", "base", "found")

_DIGIT, _LOWER, _UPPER = (48, 57), (97, 122), (65, 90)
#: Classes of characters, from fine to coarse, each of one or more ranges of bytes.
PARTITIONS = (((_DIGIT,), ((97, 102),), ((103, 122),), (_UPPER,)), ((_DIGIT,), (_LOWER,), (_UPPER,)), ((_DIGIT,), (_LOWER, _UPPER)), ((_DIGIT, _LOWER, _UPPER),))
_OWN = b"+/_.=-"
#: What candidates consist of; dots at their ends are punctuation.
_TOKEN = W.table(_DIGIT, _LOWER, _UPPER, *((c, c) for c in b"+/_.-"))
_WORDS = re.compile(r"[A-Z]?[a-z]+(?:[._/-]+[A-Z]?[a-z]*)*")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, sorted."""
    out = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def value(text: str, span: tuple[int, int, int]) -> str:
    found = text[span[0] : span[2]]
    return _ASSIGN.match(found)[2] if span[1] == 0 else found


def plausible(kind: str, found: str) -> bool:
    return kind != "assign" or not _WORDS.fullmatch(found)


# Inference


@dataclass
class State:
    ends: int = 0
    to: dict[Hashable, list[int]] = field(default_factory=dict)  # symbol: [state, count]

    @property
    def total(self) -> int:
        return self.ends + sum(n for _, n in self.to.values())


def differ(n1: int, f1: int, n2: int, f2: int, alpha: float) -> bool:
    """Hoeffding's bound on two observed frequencies."""
    return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def prefix_tree(words: Sequence[Sequence[Hashable]]) -> dict[int, State]:
    states = {0: State()}
    for word in words:
        at = 0
        for k in word:
            step = states[at].to.get(k)
            if step is None:
                step = states[at].to[k] = [len(states), 0]
                states[step[0]] = State()
            step[1] += 1
            at = step[0]
        states[at].ends += 1
    return states


def infer(words: Sequence[Sequence[Hashable]], alpha: float = ALPHA, least: int = LEAST_SEEN) -> dict[int, State]:
    """A deterministic automaton, from 0, with the counts of the words: their prefix tree, whose states are merged in
    breadth-first order with the first state found before that is compatible."""
    states = prefix_tree(words)

    def compatible(a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            x, y = states[a], states[b]
            n, m = x.total, y.total
            if n < least or m < least:
                continue
            if differ(n, x.ends, m, y.ends, alpha):
                return False
            for k in {*x.to, *y.to}:
                p, q = x.to.get(k), y.to.get(k)
                if differ(n, p[1] if p else 0, m, q[1] if q else 0, alpha):
                    return False
                if p and q and p[0] != q[0]:
                    stack.append((p[0], q[0]))
        return True

    def fold(a: int, b: int) -> None:
        """Adds the tree below b to the automaton at a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            x, y = states[a], states.pop(b)
            x.ends += y.ends
            for k, (to, n) in y.to.items():
                if k in x.to:
                    x.to[k][1] += n
                    stack.append((x.to[k][0], to))
                else:
                    x.to[k] = [to, n]

    red, known = [0], {0}
    blue = [(to, 0, k) for k, (to, _) in states[0].to.items()]
    while blue:
        b, parent, symbol = blue.pop(0)
        step = states[parent].to.get(symbol)
        if step is None or step[0] != b or b in known:
            continue
        seen = states[b].total >= least
        target = next((r for r in red if states[r].total >= least and compatible(r, b)), None) if seen else None
        if target is None:
            red.append(b)
            known.add(b)
            blue += [(to, b, k) for k, (to, _) in states[b].to.items()]
        else:
            step[0] = target
            fold(target, b)
            # Folding may have given states found before new steps.
            blue += [(to, r, k) for r in red for k, (to, _) in states[r].to.items() if to not in known]
    return {r: states[r] for r in red}


# Credentials as words of symbols


def partition(classes) -> np.ndarray:
    """The symbol of each byte: 1, 2, ... for classes and then for the characters that stand alone; 0 for the rest."""
    out = np.zeros(256, np.int64)
    for i, ranges in enumerate(classes):
        out[W.table(*ranges)] = i + 1
    out[list(_OWN)] = len(classes) + 1 + np.arange(len(_OWN))
    return out


def common_prefix(values: list[bytes], least: int = LEAST_SEEN) -> bytes:
    """The longest prefix that PREFIX_SHARE of the values, and `least` of them, begin with and go on after."""
    out = b""
    while True:
        after = Counter(v[len(out)] for v in values if v.startswith(out) and len(v) > len(out) + 1)
        if not after or (best := after.most_common(1)[0])[1] < max(least, PREFIX_SHARE * len(values)):
            return out
        out += bytes([best[0]])


class Automaton:
    """An inferred automaton over the symbols of one partition, with what is needed to score many tokens at once."""

    def __init__(self, values: list[bytes], classes, prefix: bytes, alpha: float = ALPHA, least: int = LEAST_SEEN):
        self.symbol, self.prefix = partition(classes), prefix
        own = len(classes) + len(_OWN) + 1
        self.rest, self.first = own, own + 1  # the symbol of all beyond DEPTH, and of the prefix's first character
        inside, tail = np.zeros(256), np.zeros(256)
        for v in values:
            for c in v[self._literal(v) : DEPTH]:
                inside[c] += 1
            for c in v[DEPTH:]:
                tail[c] += 1
        states = infer([self.word(v) for v in values], alpha, least)
        place = {s: i for i, s in enumerate(states)}
        n, symbols = len(states), self.first + len(prefix)
        self.to, self.log = np.full((n, symbols), -1), np.full((n, symbols), -np.inf)
        self.end = np.full(n, -np.inf)
        for s, i in place.items():
            total = states[s].total
            if states[s].ends:
                self.end[i] = math.log(states[s].ends / total)
            for k, (to, count) in states[s].to.items():
                self.to[i, k], self.log[i, k] = place[to], math.log(count / total)
        # Characters inside their class, smoothed over the class.
        self.emit = np.zeros(256)
        for k in range(1, self.rest):
            at = self.symbol == k
            self.emit[at] = np.log((inside[at] + 0.5) / (inside[at].sum() + 0.5 * at.sum()))
        self.tail = np.log((tail + 0.5) / (tail.sum() + 0.5 * 64))
        self.threshold = math.inf
        self.mixes: set[tuple[bool, bool]] = {(True, True)}

    def _literal(self, value: bytes) -> int:
        return next((i for i, (a, b) in enumerate(zip(value, self.prefix, strict=False)) if a != b), min(len(value), len(self.prefix)))

    def word(self, value: bytes) -> tuple[int, ...]:
        n = min(self._literal(value), DEPTH)
        out = [self.first + i for i in range(n)] + self.symbol[list(value[n:DEPTH])].tolist()
        return (*out, self.rest) if len(value) > DEPTH else tuple(out)

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Of each span of data the mean log-likelihood ratio a character against the background `plain`; -inf where
        the automaton can't produce it. All spans take each step together, DEPTH of them at most."""
        size = ends - starts
        out = np.full(len(starts), -np.inf)
        live, state, total, literal = np.arange(len(starts)), np.zeros(len(starts), np.int64), np.zeros(len(starts)), np.ones(len(starts), bool)
        for i in range(DEPTH + 1):
            over = size[live] == i
            at = live[over]
            out[at] = (total[at] + self.end[state[at]]) / (size[at] + 1)
            live = live[~over]
            if not len(live) or i == DEPTH:
                break
            c = data[starts[live] + i]
            k, ratio = self.symbol[c], self.emit[c] - plain[c]
            if i < len(self.prefix):
                literal[live] &= c == self.prefix[i]
                k, ratio = np.where(literal[live], self.first + i, k), np.where(literal[live], -plain[c], ratio)
            total[live] += self.log[state[live], k] + ratio
            state[live] = self.to[state[live], k]
            live = live[state[live] >= 0]
        if len(live):
            ratio = self.tail - plain
            for j in live[self.to[state[live], self.rest] >= 0].tolist():
                rest = float(ratio[data[starts[j] + DEPTH : ends[j]]].sum())
                out[j] = (total[j] + self.log[state[j], self.rest] + rest) / (size[j] + 1)
        return out

    def likelihood(self, values: list[bytes]) -> float:
        """Sum of the values' log-likelihoods; one that can't be produced counts as random characters and 10 more."""
        found = self.scores(*spans_of(values), np.zeros(256)) if values else np.zeros(0)
        size = np.array([len(v) for v in values])
        return float(np.where(np.isfinite(found), found * (size + 1), -size * math.log(64) - 10).sum())


def spans_of(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(v) for v in values]).astype(np.int64)
    return np.frombuffer(b"".join(values), np.uint8), np.append(0, ends[:-1]).astype(np.int64), ends


def _mix(value: bytes) -> tuple[bool, bool]:
    """Whether it has a digit, and a letter."""
    return any(48 <= c <= 57 for c in value), any(65 <= c <= 90 or 97 <= c <= 122 for c in value)


def learn(values: list[bytes], plain: np.ndarray, alpha: float = ALPHA, least: int = LEAST_SEEN) -> Automaton:
    """An automaton of one kind; its partition and threshold come from values that were held out."""
    half, rest = values[::2], values[1::2]
    tried = [Automaton(half, classes, common_prefix(half, least), alpha, least) for classes in PARTITIONS]
    best = max(range(len(tried)), key=lambda i: (tried[i].likelihood(rest), i))
    seen = np.sort(tried[best].scores(*spans_of(rest), plain)) if rest else np.zeros(0)
    seen = seen[np.isfinite(seen)]
    out = Automaton(values, PARTITIONS[best], common_prefix(values, least), alpha, least)
    out.threshold = max(1.0, float(seen[len(seen) // 100])) if len(seen) else 1.0
    out.mixes |= set(map(_mix, values))
    return out


@dataclass
class Model:
    automata: dict[str, Automaton]
    plain: np.ndarray  # log of each byte's share of the corpus
    least: int  # characters of a candidate

    def accepted(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of these spans are credentials."""
        out = np.zeros(len(starts), bool)
        if not len(starts):
            return out
        some = lambda *ranges: (s := np.append(0, np.cumsum(W.table(*ranges)[data])))[ends] > s[starts]
        digit, letter = some(_DIGIT), some(_LOWER, _UPPER)
        for a in self.automata.values():
            fits = np.zeros(len(starts), bool)
            for has_digit, has_letter in a.mixes:
                fits |= (digit == has_digit) & (letter == has_letter)
            at = np.flatnonzero(fits & ~out)
            out[at] = a.scores(data, starts[at], ends[at], self.plain) >= a.threshold
        return out


def fit(labelled: dict[str, list[str]], background: np.ndarray, alpha: float = ALPHA, least: int = LEAST_SEEN) -> Model:
    """background: the number of each byte in all texts."""
    plain = np.log((background + 1) / (background.sum() + 64))
    sizes, automata = [], {}
    for kind, found in sorted(labelled.items()):
        values = sorted({v.strip(".").rstrip("=").encode() for v in found if plausible(kind, v)} - {b""})
        if values:
            # Shuffled by a fixed rule, so that halves don't depend on the values' order.
            values = [v for _, v in sorted(zip(W.span_hash(*spans_of(values)).tolist(), values, strict=True))]
            automata[kind] = learn(values, plain, alpha, least)
            sizes += map(len, values)
    return Model(automata, plain, max(min(sizes, default=_MIN_ASSIGN), _MIN_ASSIGN))


def train(docs: DataFrame, *, text: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """Automata of the base spans' values. Values are gathered from all texts, at most max_labelled distinct
    ones a kind (the smallest hashes) are learned from; the background counts the bytes of all texts."""

    def gather(batches):
        seen = np.zeros(256, np.int64)
        for batch in batches:
            data, _ = W.buffers(batch.column(0))
            seen += np.bincount(data, minlength=256)
            kinds, values = [], []
            for t in batch.column(0).to_pylist():
                for span in base_spans(t or ""):
                    v = value(t, span)
                    if plausible(KINDS[span[1]], v):
                        kinds.append(KINDS[span[1]])
                        values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array([1] * len(kinds), pa.int64())], names=["kind", "value", "n"])
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([""] * len(at), pa.string()), pa.array([str(i) for i in at.tolist()], pa.string()), pa.array(seen[at])], names=["kind", "value", "n"])

    small_batches(docs.sparkSession)
    counted = docs.select(text).mapInArrow(gather, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")).withColumn("h", F.xxhash64("value"))
    background, labelled = np.zeros(256), {}
    counted = written(counted, "credentials")
    for r in counted.where("kind = ''").collect():  # 256 rows at most
        background[int(r.value)] = r.n
    for kind in KINDS:
        labelled[kind] = [r.value for r in counted.where(F.col("kind") == kind).orderBy("h", "value").limit(max_labelled).collect()]
    return fit(labelled, background)


# Scanning


def tokens(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the candidates of at least so many characters."""
    starts, ends, rows = W.spans(data, offsets, _TOKEN)
    while len(dots := np.flatnonzero((ends > starts) & (data[np.maximum(ends - 1, 0)] == 46))):
        ends[dots] -= 1
    while len(dots := np.flatnonzero((ends > starts) & (data[np.minimum(starts, len(data) - 1)] == 46))):
        starts[dots] += 1
    keep = ends - starts >= least
    return starts[keep], ends[keep], rows[keep]


def _apart(starts: np.ndarray, ends: np.ndarray, base: list[tuple[int, int, int]]) -> np.ndarray:
    """Which spans overlap none of base, sorted by start."""
    if not base:
        return np.ones(len(starts), bool)
    last = np.append(-1, np.maximum.accumulate([e for _, _, e in base]))
    return last[np.searchsorted([s for s, _, _ in base], ends, "left")] <= starts


def scan(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex, and arrays base and found of (kind, start, end), by start."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*RESULTS)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in RESULTS[:3]], T.StructField("base", span), T.StructField("found", span)])
    kind_of = [*KINDS, "format"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def look(batches):
        own = sent.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            base = [base_spans(t or "") for t in column.to_pylist()]
            more: list[list] = [[] for _ in base]
            for first, _, data, offsets in W.slices(column) if own is not None and own.automata else ():
                starts, ends, rows = tokens(data, offsets, own.least)
                good = own.accepted(data, starts, ends)
                if not good.any():
                    continue
                # Positions are code points: bytes that begin one, from the row's first.
                points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                starts, ends, rows = starts[good], ends[good], rows[good]
                starts, ends = points[starts] - points[offsets[rows]], points[ends] - points[offsets[rows]]
                cuts = W.bounds(rows, len(offsets) - 1)
                for row in np.unique(rows).tolist():
                    a, b = starts[cuts[row] : cuts[row + 1]], ends[cuts[row] : cuts[row + 1]]
                    free = _apart(a, b, base[first + row])
                    more[first + row] = [(x, 3, y) for x, y in zip(a[free].tolist(), b[free].tolist(), strict=True)]
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(3)]
            named = lambda spans: [{"kind": kind_of[k], "start": a, "end": b} for a, k, b in spans]
            found = pa.array([named(sorted(x + y)) for x, y in zip(base, more, strict=True)], struct)
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts, pa.array(map(named, base), struct), found], names=[*batch.schema.names, *RESULTS])

    return docs.mapInArrow(look, schema)


def joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"))
