"""Ranked lexical search over the fields of handles.

Every text of a handle is one field row: its identifier, title, front matter, headings and body spans. Texts and
queries are normalised alike (lower case, split at what is no letter or digit, stemmed, joined by blanks) with
column expressions only, so the searches of a block are one scan that scores all fields of all handles, one aggregate
for the specificity of their terms, and joins for clusters and boosts. Scores are 32-bit floats.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lifecycle

#: Weights, boosts and thresholds of the ranking.
FIELD_WEIGHT = {"identifier": 1.0, "title": 0.95, "heading": 0.90, "body": 0.82}
FRONTMATTER_WEIGHT, OTHER_WEIGHT = 0.88, 0.75
STATUS_BOOST = {
    "authoritative": 0.08, "current": 0.08, "stable": 0.08, "living": 0.08, "published": 0.08, "approved": 0.06,
    "active": 0.04, "review": 0.04, "research": 0.03, "plan": 0.03, "exploratory": 0.02, "draft": 0.0, "raw": 0.0,
}
HUB_BOOST, HUB_MOST = 0.01, 0.12
HEAD_BOOST, SUPERSEDED_PENALTY, PATH_PENALTY = 0.10, 0.12, 0.08
CLUSTER_LEAST, CLUSTER_BOOST, CLUSTER_MOST = 0.70, 0.15, 0.99
PARTIAL_BASE, PARTIAL_SPAN, SPECIFICITY = 0.35, 0.55, 1.5
LOW_CONFIDENCE = 0.5
#: Abbreviations and what they stand for.
EXPANSIONS = {"oq": {"open": 0.25, "question": 0.25}, "adr": {"architecture": 0.2, "decision": 0.2, "record": 0.2}, "rfc": {"request": 0.2, "comment": 0.2}}
ABBREVIATED = {("open", "question"): ("oq", 2.0), ("architecture", "decision", "record"): ("adr", 3.0), ("request", "for", "comment"): ("rfc", 3.0)}

#: Queries that one plan holds; the hits of more are written block by block.
BLOCK = 20


def _undoubled(word: str) -> str:
    return word[:-1] if len(word) > 1 and word[-1] == word[-2] else word


def stem(word: str) -> str:
    """One word, by length in bytes; the column form is stem_column()."""
    n = len(word.encode())
    if n > 6 and word.endswith("ation"):
        word = word[:-5]
    elif n > 5 and word.endswith("ing"):
        word = _undoubled(word[:-3])
    elif n > 4 and word.endswith("ies"):
        word = word[:-3] + "y"
    elif n > 4 and word.endswith("ed"):
        word = _undoubled(word[:-2])
    elif n > 3 and word.endswith("s"):
        word = word[:-1]
    if len(word.encode()) > 6 and word.endswith("ure"):
        word = word[:-1]
    return word


def normalise(text: str) -> str:
    return " ".join(stem(w) for w in re.split(r"[\W_]+", text.lower()) if w)


def _cut(w: Column, n: int) -> Column:
    return w.substr(F.lit(1), F.char_length(w) - n)


def _shortened(w: Column) -> Column:
    """stem() but for its last step."""
    n = F.octet_length(w)
    single = lambda c: F.regexp_replace(c, r"(.)\1$", "$1")
    return (
        F.when((n > 6) & w.endswith("ation"), _cut(w, 5))
        .when((n > 5) & w.endswith("ing"), single(_cut(w, 3)))
        .when((n > 4) & w.endswith("ies"), F.concat(_cut(w, 3), F.lit("y")))
        .when((n > 4) & w.endswith("ed"), single(_cut(w, 2)))
        .when((n > 3) & w.endswith("s"), _cut(w, 1))
        .otherwise(w)
    )


def _unending(w: Column) -> Column:
    return F.when((F.octet_length(w) > 6) & w.endswith("ure"), _cut(w, 1)).otherwise(w)


def stem_column(w: Column) -> Column:
    return _unending(_shortened(w))


def normal_column(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    # The last step reads what the others make three times, so it is a pass of its own.
    return F.array_join(F.transform(F.transform(words, _shortened), _unending), " ")


def query_terms(query: str) -> dict[str, float]:
    """Terms of a normalised query with their weights: words, pairs, triples and abbreviations."""
    words = normalise(query).split()
    out: dict[str, float] = {}

    def add(term: str, weight: float) -> None:
        term = stem(term)
        out[term] = max(out.get(term, 0.0), weight)

    for w in words:
        add(w, 1.0)
        for expanded, weight in EXPANSIONS.get(w, {}).items():
            add(expanded, weight)
    for size, weight in ((2, 2.0), (3, 3.0)):
        for i in range(len(words) - size + 1):
            part = tuple(words[i : i + size])
            add(" ".join(part), weight)
            if part in ABBREVIATED:
                add(*ABBREVIATED[part])
    return out


def fields(ctx) -> DataFrame:
    """corpus, source, handle, span_id, field, reason, text (normalised) of every searchable text."""
    h, m, c, s = (ctx.relation(r) for r in ("handle", "meta", "content", "span"))
    none = F.lit(None).cast("string")
    entry = lambda field, reason, text: F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"), text.alias("text"))
    value = "frontmatter-value-match"
    own = F.array(entry("identifier", "identifier-substring", F.col("id")), entry("title", "title-substring", F.col("summary")), *[entry(f"frontmatter:{k}", value, F.col(k)) for k in ("status", "namespace", "area", "kind")])
    parts = h.select("corpus", "source", F.col("id").alias("handle"), none.alias("span_id"), F.explode(own).alias("e")).select("corpus", "source", "handle", "span_id", "e.field", "e.reason", "e.text")
    name = F.concat(F.lit("frontmatter:"), F.col("key"))
    pair = F.array(F.struct(F.lit("frontmatter-key-match").alias("reason"), F.col("key").alias("text")), F.struct(F.lit(value).alias("reason"), F.col("value").alias("text")))
    metas = m.select("corpus", "source", "handle", none.alias("span_id"), name.alias("field"), F.explode(pair).alias("e")).select("corpus", "source", "handle", "span_id", "field", "e.reason", "e.text")
    bodies = c.select("corpus", "source", "handle", "span_id", F.lit("body"), F.lit("body-substring"), "text")
    heads = s.where(F.contains("id", F.lit("#h/"))).select("corpus", "source", "handle", F.col("id"), F.lit("heading"), F.lit("heading-substring"), "summary")
    rows = parts.union(metas).union(bodies).union(heads).where("text is not null and text <> ''")
    return rows.withColumn("text", normal_column(F.col("text")))


def boosts(ctx) -> DataFrame:
    """corpus, source, handle, kind, parent, boost of each handle."""
    config = ctx.relation("config")
    given = {r.key: r.value for r in config.where(F.col("key").startswith("search_boost.")).collect()}
    table = dict(STATUS_BOOST)
    for k, v in given.items():
        if k.startswith("search_boost.status."):
            table[k.removeprefix("search_boost.status.").lower()] = float(v)
    hub = float(given.get("search_boost.hub_edge", HUB_BOOST))
    h, e = ctx.relation("handle"), ctx.relation("edge")
    keys = ["corpus", "source", "handle"]
    into = e.groupBy("corpus", "source", F.col("to").alias("handle")).agg(F.count("*").alias("n"), F.max(F.col("kind") == "Supersedes").alias("heir"))
    out = e.where("kind = 'Supersedes'").select("corpus", "source", F.col("from").alias("handle"), F.lit(True).alias("gone")).distinct()
    rows = h.select("corpus", "source", F.col("id").alias("handle"), "kind", F.lower("status").alias("status"), F.when((F.col("file") != "") & (F.col("file") != F.col("id")), F.col("file")).alias("parent"))
    rows = rows.join(into, keys, "left").join(out, keys, "left")
    status = F.lit(0.0)
    for k, v in table.items():
        status = F.when(F.col("status") == k, F.lit(v)).otherwise(status)
    status = F.when(F.col("kind").isin("label", "external"), F.lit(0.0)).otherwise(status)
    hubs = F.least(F.coalesce("n", F.lit(0)) * F.lit(hub), F.lit(HUB_MOST))
    gone, heir = F.coalesce("gone", F.lit(False)), F.coalesce("heir", F.lit(False))
    current = F.when((F.col("kind") != "file") | F.col("kind").isNull(), 0.0).when(gone, -SUPERSEDED_PENALTY).when(heir & F.col("status").isin(*lifecycle.SETTLED), HEAD_BOOST).otherwise(0.0)
    total = (status.cast("float") + hubs.cast("float") + current.cast("float")).cast("float")
    return rows.select(*keys, "kind", "parent", F.least(F.greatest(total, F.lit(0.0).cast("float")), F.lit(1.0).cast("float")).alias("boost"))


def _clamped(c: Column) -> Column:
    return F.least(F.greatest(c.cast("float"), F.lit(0.0).cast("float")), F.lit(1.0).cast("float"))


def ranked(ctx, queries: list[str], texts: DataFrame | None = None) -> DataFrame:
    """All hits of some queries: query, corpus, source, handle, span_id, score, reason, field, low_confidence. The
    texts are read twice, however many queries there are."""
    for query in queries:
        if not normalise(query):
            raise ValueError("search needs a query with a word")
    texts = fields(ctx) if texts is None else texts
    terms = {q: query_terms(q) for q in queries}
    flags = {t: F.contains(F.col("text"), F.lit(t)) for t in dict.fromkeys(t for own in terms.values() for t in own)}
    total = texts.agg(F.count("*").alias("all"), *[F.sum(c.cast("long")).alias(f"n{i}") for i, c in enumerate(flags.values())]).first()
    full = min(total["all"], 65535)
    seen = {t: min(total[f"n{i}"] or 0, 65535) for i, t in enumerate(flags)}

    def strength(query: str) -> Column:
        """How well a text fits a query, or null."""
        weights = {t: w * (1.0 + SPECIFICITY * ((full - seen[t]) / full if full else 0.0)) for t, w in terms[query].items()}
        target = max(1.0, sum(weights.values()))
        matched = sum((F.when(flags[t], F.lit(w)).otherwise(F.lit(0.0)) for t, w in weights.items()), F.lit(0.0)).cast("float")
        partial = (F.lit(PARTIAL_BASE) + F.lit(PARTIAL_SPAN) * F.least(F.lit(1.0), matched / F.lit(target))).cast("float")
        return F.when(F.contains(F.col("text"), F.lit(normalise(query))), F.lit(1.0).cast("float")).when(matched > 0, partial)

    tried = F.array(*[F.struct(F.lit(q).alias("query"), strength(q).alias("raw")) for q in queries])
    hits = texts.withColumn("hit", F.explode(F.filter(tried, lambda x: x["raw"].isNotNull())))
    # Written, as hits and clusters read them: the texts are scored once.
    hits = ctx.shared(hits.select("hit.query", "hit.raw", *[c for c in texts.columns if c != "text"]))

    # A body of the whole document gives way to narrower spans.
    is_full = F.col("span_id") == F.concat(F.col("handle"), F.lit("#full"))
    narrow = texts.where((F.col("field") == "body") & ~is_full).select("corpus", "source", "handle", F.lit(True).alias("narrow")).distinct()
    keys = ["corpus", "source", "handle"]
    hits = hits.join(narrow, keys, "left").where(~((F.col("field") == "body") & F.coalesce(is_full, F.lit(False)) & F.coalesce("narrow", F.lit(False)))).drop("narrow")

    known = boosts(ctx)
    hits = hits.join(known, keys, "left")
    weight = F.lit(OTHER_WEIGHT)
    for k, v in FIELD_WEIGHT.items():
        weight = F.when(F.col("field") == k, v).otherwise(weight)
    weight = F.when(F.col("field").startswith("frontmatter:"), FRONTMATTER_WEIGHT).otherwise(weight).cast("float")
    old = F.when(F.contains("handle", F.lit("/history/")) | F.contains("handle", F.lit("/prior/")), F.lit(PATH_PENALTY)).otherwise(F.lit(0.0)).cast("float")
    hits = hits.withColumn("score", _clamped(F.col("raw") * weight + F.coalesce("boost", F.lit(0.0).cast("float")) - old))

    # Parents of several strong children.
    direct = hits.groupBy("query", *keys).agg(F.max(F.when(F.col("field").isin("identifier", "title"), F.col("raw"))).alias("structural"), F.max("score").alias("direct"))
    parents = known.select("corpus", "source", F.col("handle").alias("parent"))
    clusters = hits.where("parent is not null").groupBy("query", "corpus", "source", "parent").agg(F.count_distinct("handle").alias("n"), F.max("raw").alias("best")).where((F.col("n") >= 2) & (F.col("best") >= F.lit(CLUSTER_LEAST).cast("float")))
    clusters = clusters.join(parents, ["corpus", "source", "parent"], "left_semi").where(~F.lower("parent").rlike(r"(^|/)labels\.md$")).withColumnRenamed("parent", "handle")
    lifted = F.least(_clamped(F.col("best") + F.lit(CLUSTER_BOOST).cast("float")), F.lit(CLUSTER_MOST).cast("float"))
    zero = F.lit(0.0).cast("float")
    clusters = clusters.join(direct, ["query", *keys], "left").withColumn("raw", lifted).where((F.col("best") > F.coalesce("structural", zero)) & (F.col("raw") > F.coalesce("direct", zero)))
    grouped = clusters.select("query", *keys, F.lit(None).cast("string").alias("span_id"), F.lit("identifier").alias("field"), F.lit("parent-cluster").alias("reason"), _clamped(F.col("raw") - old).alias("score"))
    out = hits.select("query", *keys, "span_id", "field", "reason", "score").union(grouped)
    return out.select("query", *keys, "span_id", "score", "reason", "field", (F.col("score") < F.lit(LOW_CONFIDENCE).cast("float")).alias("low_confidence"))


def order() -> list[Column]:
    """The total order of hits, best first."""
    rank = F.lit(5)
    for n, (reasons, field) in ((4, (("body-substring",), "body")), (2, (("parent-cluster",), "identifier")), (1, (("heading-substring",), "heading")), (0, (("title-substring",), "title")), (0, (("identifier-substring",), "identifier"))):
        rank = F.when(F.col("reason").isin(*reasons) & (F.col("field") == field), n).otherwise(rank)
    rank = F.when(F.col("reason").isin("frontmatter-key-match", "frontmatter-value-match"), 3).otherwise(rank)
    return [F.col("score").desc(), F.col("corpus"), F.col("source"), rank, F.contains("handle", F.lit("#")), F.col("handle"), F.col("span_id").asc_nulls_first(), F.col("field"), F.col("reason")]


def search(ctx, seeds: DataFrame) -> DataFrame:
    """(query, handle, span_id, score, reason, field, low_confidence)."""
    ctx.require("Search")
    # Normalised once, for all queries.
    texts = ctx.shared(fields(ctx))

    def hits(queries: list[str]) -> DataFrame:
        found = ranked(ctx, queries, texts)
        return found.select(F.col("query").alias("p0"), F.col("handle").alias("p1"), F.col("span_id").alias("p2"), F.col("score").cast("double").alias("p3"), F.col("reason").alias("p4"), F.col("field").alias("p5"), F.col("low_confidence").alias("p6")).distinct()

    out: DataFrame | None = None
    block: list[str] = []
    for r in seeds.select("p0").distinct().toLocalIterator():
        if len(block) == BLOCK:
            done = ctx.written(hits(block))
            out = done if out is None else out.union(done)
            block = []
        block.append(r.p0)
    if not block:
        return ctx.local([], "p0 string, p1 string, p2 string, p3 double, p4 string, p5 string, p6 boolean")
    return hits(block) if out is None else out.union(hits(block))
