"""The pipeline, stage by stage, against plain versions."""

import random
import re

import corpus_pipeline as P
from test_texts import plain_components, plain_hits, prose
from test_tables import plain_removal

WORDS = {"en": ["the", "and", "thing", "ering", "with"], "de": ["und", "schei", "keit", "ung", "der"]}


def corpus(rng):
    say = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(n))
    rows = []
    for i in range(160):
        lang = rng.choice(list(WORDS))
        rows.append([i, "\n".join(say(lang, 30) for _ in range(rng.randrange(1, 4))), lang, f"src{i % 12}", 0])
    for i in range(20, 32):
        rows[i][1] += "\nshared footer of all sites"
    item = say("en", 20)
    rows[40][1] = item
    rows[41][1] = rows[42][1] + " x"
    rows[43][1], rows[44][1] = "12 34", None
    return [tuple(r) for r in rows], [(1, item), (2, say("en", 15))]


def test_pipeline(spark, documents, tmp_path):
    rng = random.Random(12)
    rows, bench = corpus(rng)
    docs = documents(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(P.STAGES)
    take = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)

    one = stage["language"](spark, docs, str(tmp_path))
    kept = take(one)
    assert {r[0] for r in rows} - {r[0] for r in kept} == {43, 44} and one.columns == docs.columns

    two = stage["lines"](spark, documents(kept), str(tmp_path))
    want = [(i, t, *r[2:4], len(t)) for (i, t), r in zip(plain_removal(kept, P.lines.MIN_SITES), kept, strict=True) if t == r[1] or re.search(r"\S", t)]
    assert take(two) == sorted(want, key=repr)

    three = stage["near"](spark, documents(take(two)), str(tmp_path))
    linked = plain_components([(r[0], r[1]) for r in take(two)])
    assert {r[0] for r in take(three)} == {c for _, _, c in linked}
    assert not {41, 42} <= {r[0] for r in take(three)}

    four = stage["benchmark"](spark, documents(take(three)), str(tmp_path))
    hits = {r[0]: plain_hits(r[1], bench) for r in take(three)}
    assert {r[0] for r in take(four)} == {i for i, (n, hit, _) in hits.items() if not (hit and 20 * hit >= n)}
    assert 40 not in {r[0] for r in take(four)}

    five = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in five} == {r[0] for r in take(four)}
    assert sum(r.n_tokens for r in five) == sum(len(r[1].split()) for r in take(four))
    assert prose(rng, 1)


def test_near_stage_links_at_five_words_and_four_fifths(spark, documents):
    rng = random.Random(14)
    rows = []
    for _ in range(12):
        base = prose(rng, 140, 5000).split()
        rows.append((len(rows), " ".join(base)))
        for edits in (1, 2, 3, 4, 6):
            w = list(base)
            for e in range(edits):
                w[10 + 20 * e] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    docs = documents([(i, t, "en", "s", 0) for i, t in rows])
    kept = {r.doc_id for r in P.near_stage(spark, docs, "").collect()}
    assert kept == {c for _, _, c in plain_components(rows, 5, (80, 100))}
    # Alone, a copy of three edits is near at these values but not at those of op3.
    pair = [rows[0], rows[3]]
    assert len({c for _, _, c in plain_components(pair)}) == 2
    assert {r.doc_id for r in P.near_stage(spark, docs.where("doc_id in (0, 3)"), "").collect()} == {0}


def test_odd_rows_in_every_stage(spark, documents, tmp_path):
    rng = random.Random(31)
    rows, bench = corpus(rng)
    odd = [(None, rows[50][1], None, None, None), (7, None, None, None, None), (8, "", "en", "s", 0), rows[60], rows[60], (500, rows[60][1], None, None, 0), (501, "the and " * 60_000, "en", "src1", 0)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents([(*r, "x", 5) for r in rows + odd], ", n_hit string, lang_pred long")
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        empty = stage(spark, documents([], ", n_hit string, lang_pred long"), str(tmp_path))
        assert empty.count() == 0 and empty.columns == out.columns
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        kept = [r.doc_id for r in out.collect()]
        assert None in kept and 8 not in [r.doc_id for r in out.collect() if name != "packing" and not r.text] and 501 in kept
        if name == "near":
            # Copies of document 60 under another id go; rows that repeat it stay.
            assert kept.count(60) == 3 and 500 not in kept
    assert sum(r.n_tokens for r in out.where("doc_id = 501").collect()) == 120_000


def test_packing_stage_packs_what_is_left(spark, documents):
    rng = random.Random(32)
    rows = [(i, prose(rng, rng.randrange(0, 5000)), "en", "s", 0) for i in range(40)]
    got = P.packing_stage(spark, documents(rows), "").collect()
    text = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        text[r.doc_id] = text.get(r.doc_id, "") + r.text
    assert text == {i: t for i, t, *_ in rows}
