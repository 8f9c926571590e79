"""Packing, archives, pseudonyms, line removal and rollups."""

import gzip
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import lines, packing, pii, tokens, warc
from tidemark.llm._shared import new_path

# Packing


def plain_padding(lengths, counts, buckets):
    best = None
    for k in range(1, min(buckets, len(lengths)) + 1):
        for cut in itertools.combinations(lengths[:-1], k - 1):
            bounds = [*cut, lengths[-1]]
            pad = sum(n * (next(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts, strict=True))
            best = pad if best is None else min(best, pad)
    return best


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 9) for _ in lengths]
        for buckets in (1, 2, 3):
            bounds = packing.boundaries(lengths, counts, buckets)
            pad = sum(n * (next(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts, strict=True))
            assert pad == plain_padding(lengths, counts, buckets)
    assert packing.boundaries([], [], 3) == []


def test_packing(documents):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 300)), "en", "s", 0) for i in range(400)] + [(400, None, None, None, None), (401, " \n", None, None, None), (7, "w w", None, None, None), (7, "w w", None, None, None), (None, "w", None, None, None)]
    got = packing.pack(documents(rows), max_len=100, buckets=4, budget=1000).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i in (400, 401):
        assert [(r.n_tokens, r.bucket, r.batch) for r in by[i]] == [(0, None, None)]
    for i, text, *_ in rows[:400]:
        if i != 7:
            pieces = sorted(by[i], key=lambda r: r.piece)
            assert sum(r.n_tokens for r in pieces) == len(text.split()) and [r.first_token for r in pieces] == [100 * k for k in range(len(pieces))]
    batches: dict = {}
    for r in got:
        if r.batch:
            assert r.n_tokens <= r.bucket == r.padded_tokens
            batches.setdefault(r.batch, []).append(r)
    short = [b for b, rs in batches.items() if len(rs) < 1000 // rs[0].bucket]
    assert len({r.bucket for r in got if r.bucket}) <= 4 and len(short) <= 4
    for rs in batches.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs))) and len({r.bucket for r in rs}) == 1 and len(rs) * rs[0].bucket <= 1000
    assert packing.pack(documents(rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(documents(rows), max_len=10, budget=5)


def plain_places(rows, max_len, buckets, budget):
    """Number of rows of each bucket in full and in last batches, by the definition."""
    sizes = sorted(n for r in rows for n in [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))] for n in [max_len] * (n // max_len) + [n % max_len] * (n % max_len > 0))
    lengths = sorted(set(sizes))
    bounds = packing.boundaries(lengths, [sizes.count(x) for x in lengths], buckets)
    out, low = {}, 0
    for b in bounds:
        n = sum(low < x <= b for x in sizes)
        out |= {f"{b}-{i}": min(budget // b, n - i * (budget // b)) for i in range(-(-n // (budget // b)))}
        low = b
    return out


def test_pieces_have_the_whole_text(documents):
    rng = random.Random(7)
    texts = [None, "", " \n", "é", " a", "a b c", "  x  y\n\nz é w  ", "u " * 5000] + ["".join(rng.choice("ab é\n\t") for _ in range(rng.randrange(80))) for _ in range(60)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    docs = documents(rows).withColumnsRenamed({"lang": "batch", "source": "piece", "n_chars": "bucket"})
    got = packing.pack(docs, max_len=4, buckets=3, budget=20).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert (None if t is None else "".join(r.text for r in pieces)) == t and (t is not None or pieces[0].text is None)
        for r in pieces:
            words = re.findall(r"[^\x20\x09-\x0D]+", t or "")[r.first_token : r.first_token + 4]
            assert re.findall(r"[^\x20\x09-\x0D]+", r.text or "") == words and r.n_tokens == len(words)
    batches: dict = {}
    for r in got:
        if r.batch:
            batches[r.batch] = batches.get(r.batch, 0) + 1
    assert batches == plain_places(rows, 4, 3, 20)
    counted = packing.pack(docs, count=F.char_length("text"), max_len=10, budget=50).collect()
    assert all(r.text is None for r in counted) and sum(r.n_tokens for r in counted) == sum(len(t or "") for t in texts)


# Archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_id string")


def test_archive_round_trip(spark):
    big = "<p>\r\n\r\nWARC/1.1\r\né" + "x" * 1500
    rows = [(1, "http://a/x?y#z", big, "r"), (2, "http://a/2\nb", big, "r"), (3, None, "small", "r"), (4, "u", "small", "r"), (5, "u", None, "r"), (None, "u", big, "r"), (2, "http://a/2", big, "r")]
    path = new_path(spark, "round")
    warc.write_pages(pages(spark, rows), path)
    records = warc.read_records(spark, path).collect()
    assert len(records) == 21 and len({r.record_id for r in records}) == 21
    response = sorted(r.payload.decode() for r in records if r.type == "response")
    assert response == sorted(["", "small", "small", big, big])
    captures = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(captures) == 7 and all(len(c.requests) == 1 and len(c.metadata) == 1 and c.response for c in captures)
    revisit = [c.response for c in captures if c.response.type == "revisit"]
    assert len(revisit) == 2 and all(r.headers["warc-refers-to-target-uri"].startswith("http://a/2") for r in revisit)
    warc.write_pages(pages(spark, rows).limit(0), empty := new_path(spark, "empty"))
    assert warc.read_records(spark, empty).count() == 0


def test_files_are_bounded_by_bytes(spark):
    import os

    rng = random.Random(5)
    sizes = [rng.choice([10, 90, 700, 1500, 20_000, 60_000, 150_000]) for _ in range(300)] + [250_000]
    rows = [(i, f"http://a/{i}", chr(97 + i % 26) * n, "r") for i, n in enumerate(sizes)]
    path = new_path(spark, "sizes")
    warc.write_pages(pages(spark, rows).coalesce(1), path, file_bytes=200_000, revisit_bytes=10**9)
    local = path.removeprefix("file:")
    local = local[local.index("/tmp") :]
    held, n = [], 0
    for name in os.listdir(local):
        if name.endswith(".gz") and not name.startswith("."):
            with open(f"{local}/{name}", "rb") as f:
                found = [len(b.partition(b"\r\n\r\n")[2]) for h, b in warc.parse(f.read()) if h["warc-type"] == "response"]
            held.append((sum(found), len(found)))
            n += len(found)
    assert n == len(sizes) and all(total <= 200_000 or count == 1 for total, count in held) and len(held) < 200
    assert sorted(len(r.payload) for r in warc.read_records(spark, path).where("type = 'response'").collect()) == sorted(sizes)


def test_parsing_of_archives():
    record = lambda n: b"WARC/1.0\r\nWARC-Record-ID: <%d>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" % n
    members = gzip.compress(record(1)) + gzip.compress(record(2))
    assert [(h["warc-record-id"], b) for h, b in warc.parse(members)] == [("<1>", b"abc"), ("<2>", b"abc")]
    for bad in (b"HTTP/1.1\r\n\r\n", record(1)[:-6]):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


def test_assembly_in_any_direction(spark):
    rows = [("q1", "request", []), ("r1", "response", ["q1"]), ("m1", "metadata", ["q1"]), ("r2", "revisit", []), ("q2", "request", ["r2"]), ("m2", "metadata", ["q2"]), ("m3", "metadata", ["q9"]), ("q9", "request", [])]
    df = spark.createDataFrame(rows, "record_id string, type string, concurrent_to array<string>")
    got = {r.capture_id: (r.response and r.response.record_id, sorted(x.record_id for x in r.requests), sorted(x.record_id for x in r.metadata)) for r in warc.assemble(df).collect()}
    assert got == {"r1": ("r1", ["q1"], ["m1"]), "r2": ("r2", ["q2"], ["m2"]), "q9": (None, ["q9"], ["m3"])}


# Pseudonyms


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_pseudonyms(documents):
    card = "4918187128635271"
    assert luhn(card)
    texts = [
        None, "", "nothing 12 here", f"é {card}! and {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}.", f"71 {card}", "4918187128635272 stays",
        "+1 (578) 555-6437 4918187128635271", "a.b-c@mail7.example.com, A.B-C@mail7.example.com", "10.0.0.1 and 300.1.1.1 and 1.2.3", "2024-02-29 2023-02-29 31.12.1999 1999/01/05 1700-01-01", "123-45-6789",
    ]
    docs = documents([(i, t, "en", "s", 0) for i, t in enumerate(texts)]).withColumnRenamed("source", "n_card")
    got = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    assert [got[i].text for i in (0, 1, 2, 5)] == [texts[i] for i in (0, 1, 2, 5)]
    one, spaced = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", got[3].text)
    assert luhn(one) and one == spaced.replace(" ", "") != card and got[3].n_card == 2 and got[3].text.startswith("é ")
    assert got[4].text == f"71 {one}"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} " + one, got[6].text) and "555-6437" not in got[6].text
    a, b = got[7].text.split(", ")
    assert a == b and a.endswith(".invalid") and got[7].n_email == 2
    assert "10.0.0.1" not in got[8].text and got[8].text.endswith("300.1.1.1 and 1.2.3") and got[8].n_ipv4 == 1
    parts = got[9].text.split()
    assert parts[1] == "2023-02-29" and parts[4] == "1700-01-01" and got[9].n_date == 3 and re.fullmatch(r"\d{2}\.\d{2}\.\d{4}", parts[2])
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", got[10].text) and got[10].text != texts[10]
    assert pii.pseudonymise(docs, "other").where("doc_id = 4").first().text != got[4].text
    assert pii.pseudonymise(docs.limit(0), "k").count() == 0


def plain_feistel(x, a, b, key, tweak):
    import hashlib

    half = lambda i, v: int(hashlib.sha256(f"{key}|{tweak}|{i}|{v}".encode()).hexdigest()[:15], 16)
    left, right = divmod(x, b)
    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            left = (left + half(i, right) % a) % a
        else:
            right = (right + half(i, left) % b) % b
    return left * b + right


def plain_digits(digits, key, tweak):
    u = len(digits) // 2
    return str(plain_feistel(int(digits), 10**u, 10 ** (len(digits) - u), key, tweak)).zfill(len(digits))


def plain_pseudonyms(text, key):
    """The text with its personal data replaced, from the definitions of the kinds."""
    import datetime
    import hashlib

    def into(template, digits):
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in template)

    def one(m):
        m = m[0]
        digits = re.sub("[^0-9]", "", m)
        if "@" in m:
            user = hashlib.sha256(f"{key}|email|{m.lower()}".encode()).hexdigest()[:16]
            return f"u{user}@{hashlib.sha256(f'{key}|domain|{m.lower().split(chr(64))[-1]}'.encode()).hexdigest()[:8]}.invalid"
        if m[0] in "+(" or re.fullmatch(r"\d{3}[.-]\d{3}[ .-]\d{4}", m):
            rest = re.sub(r"^\+\d{1,3}[ .-]?", "", m)
            return m[: len(m) - len(rest)] + into(rest, plain_digits(re.sub("[^0-9]", "", rest), key, "phone"))
        if re.fullmatch(r"\d{3}-\d{2}-\d{4}", m):
            return into(m, plain_digits(digits, key, "ssn"))
        if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
            p = [int(o) for o in m.split(".")]
            if max(p) > 255:
                return m
            y = plain_feistel(p[0] << 24 | p[1] << 16 | p[2] << 8 | p[3], 65536, 65536, key, "ipv4")
            return ".".join(str(o).zfill(3 if len(w) > 1 and w[0] == "0" else 1) for o, w in zip([y >> 24, y >> 16 & 255, y >> 8 & 255, y & 255], m.split("."), strict=True))
        if len(m) == 10 and re.match(r"\d{4}[-/]|\d{2}\.", m):
            form = "%Y-%m-%d" if m[4] == "-" else "%Y/%m/%d" if m[4] == "/" else "%d.%m.%Y"
            try:
                d = datetime.datetime.strptime(m, form).date()
            except ValueError:
                return m
            zero = datetime.date(1800, 1, 1)
            return (zero + datetime.timedelta(plain_feistel((d - zero).days, 189, 773, key, "date"))).strftime(form) if 1800 <= d.year <= 2199 else m
        if not luhn(digits):
            return m
        new = plain_digits(digits[:-1], key, "card")
        return into(m, next(new + c for c in "0123456789" if luhn(new + c)))

    return None if text is None else re.sub(pii.PATTERN.replace("++", "+"), one, text)


def test_pseudonyms_equal_their_definition(documents):
    rng = random.Random(8)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(groups):
        body = "4" + number(sum(groups) - 2)
        digits = iter(next(body + c for c in "0123456789" if luhn(body + c)))
        return rng.choice(" -").join("".join(next(digits) for _ in range(n)) for n in groups) if len(groups) > 1 else "".join(digits)

    makers = [
        lambda: card([16]), lambda: card([4, 4, 4, 4]), lambda: card([15]), lambda: card([4, 6, 5]), lambda: card([19]), lambda: number(16),
        lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"+49 30 {number(4)} {number(3)}", lambda: f"+33 1 {number(2)} {number(2)} {number(2)} {number(2)}", lambda: f"+44-20-{number(4)}-{number(4)}",
        lambda: f"{number(3)}-{number(2)}-{number(4)}", lambda: f"{rng.randrange(300)}.{rng.randrange(300)}.1.0", lambda: "010.001.000.255",
        lambda: f"{rng.randrange(1700, 2300)}-{rng.randrange(1, 14):02}-{rng.randrange(1, 33):02}", lambda: f"{rng.randrange(1, 32):02}.{rng.randrange(1, 13):02}.{rng.randrange(1900, 2100)}", lambda: "1999/02/29",
        lambda: f"Some.One{number(2)}@mail.Example.org", lambda: "word",
    ]
    texts = [None, "", "'" * 3] + [", ".join(rng.choice(makers)() for _ in range(rng.randrange(1, 12))) + rng.choice(["", ".", " é"]) for _ in range(150)]
    texts += ["x " * 300_000 + makers[0]()] + texts[5:8]
    docs = documents([(i, t, None, None, None) for i, t in enumerate(texts)])
    key = "it's a \\ key"
    out = pii.pseudonymise(docs, key)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {i: plain_pseudonyms(t, key) for i, t in enumerate(texts)}
    assert "a \\ key" not in out._jdf.queryExecution().toString()


def test_feistel_is_a_permutation(spark):
    n = 27 * 7 * 773
    out = spark.range(n).select(F.expr(pii.feistel("id", "189L", "773L", "'k'", "'t'")).alias("y"))
    assert out.agg(F.count_distinct("y"), F.min("y"), F.max("y")).first() == (n, 0, n - 1)


# Lines


def plain_removal(rows, least):
    sites, first = {}, {}
    for i, text, _, site, _ in rows:
        for line in (text or "").split("\n"):
            if line.strip():
                sites.setdefault(line, set()).add(site)
                if i is not None:
                    first[line] = min(first.get(line, i), i)
    bad = {x for x, s in sites.items() if len(s - {None}) >= least}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if x not in bad or (i is not None and first.get(x) == i))) for i, t, *_ in rows]


def test_line_removal(documents):
    rng = random.Random(3)
    pool = [f"line {n}" for n in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 6))), "en", f"s{rng.randrange(6)}", 0) for i in range(60)]
    rows += [(60, None, "en", "s1", 0), (61, "", "en", "s1", 0), (62, "line 1\nline 2", "en", None, 0), (None, "line 1\nown", "en", "s2", 0), (0, "line 1\nline 1", "en", "s1", 0)]
    docs = documents(rows).withColumnRenamed("lang", "n_removed")
    for least in (3, 5, 6):
        got = sorted(((r.doc_id, r.text) for r in lines.remove_boilerplate(docs, min_sites=least).collect()), key=repr)
        assert got == sorted(plain_removal(rows, least), key=repr)
    assert lines.remove_boilerplate(docs.limit(0)).count() == 0


# Rollups


def test_rollups(spark):
    change = lambda *rows: spark.createDataFrame(rows, "source string, lang string, tokenizer string, op string, tokens long, old_tokens long")
    path = new_path(spark, "rollup")
    r = tokens.Rollup(spark, path)
    one = change(("a", "en", "t1", "insert", 5, None), ("a", "en", "t1", "insert", 7, None), (None, "en", "t1", "insert", 1, None), ("b", None, "t1", "insert", None, None))
    assert r.totals().count() == 0
    assert r.apply(0, one) and not r.apply(0, one)
    assert r.apply(1, change(("a", "en", "t1", "delete", 5, None), ("a", "en", "t1", "revise", 9, 7), ("b", None, "t1", "delete", 0, None)))
    want = {("a", "en", "t1", 1, 9), (None, "en", "t1", 1, 1)}
    rows = lambda x: {tuple(y) for y in x.totals().collect()}
    assert rows(r) == want
    r.compact()
    again = tokens.Rollup(spark, path)
    assert rows(again) == want and not again.apply(1, one) and rows(again) == want
    # A batch whose sums were written but never committed leaves no trace, and can be applied later.
    one.groupBy("source", "lang", "tokenizer").agg(F.lit(9).cast("long").alias("docs"), F.lit(9).cast("long").alias("tokens")).write.parquet(f"{path}/sums/2")
    assert rows(again) == want
    assert again.apply(2, one.limit(0)) and rows(again) == want
    with pytest.raises(Exception, match="unknown op"):
        again.apply(3, change(("a", "en", "t1", "upsert", 1, None)))
    assert rows(again) == want


def test_many_batches(spark):
    """A thousand commits are folded, their markers go, and their ids stay known; columns of other names are ignored."""
    import json
    import os

    path = new_path(spark, "rollup")
    r = tokens.Rollup(spark, path)
    change = spark.createDataFrame([("a", "en", "t", "insert", 2, None, "x", 7)], "source string, lang string, tokenizer string, op string, tokens long, old_tokens long, docs string, batch long")
    assert r.apply(7, change)
    local = path.removeprefix("file:")
    local = local[local.index("/tmp") :]
    with open(f"{local}/commits/7.json") as f:
        sums = json.load(f)["sums"]
    for i in [*range(1000), 5000]:
        if i != 7:
            with open(f"{local}/commits/{i}.json", "w") as f:
                json.dump({"batch": i, "sums": sums, "folds": []}, f)
    total = lambda: [tuple(x) for x in r.totals().collect()]
    assert total() == [("a", "en", "t", 1001, 2002)]
    r.compact()
    assert total() == [("a", "en", "t", 1001, 2002)] and r.committed() == [-2]
    assert sum(x.endswith(".json") for x in os.listdir(f"{local}/commits")) == 1
    assert r.seen(999) and r.seen(5000) and not r.seen(1000) and not r.apply(500, change)
    # A marker that a stopped compaction left counts once.
    with open(f"{local}/commits/3.json", "w") as f:
        json.dump({"batch": 3, "sums": sums, "folds": []}, f)
    assert total() == [("a", "en", "t", 1001, 2002)]
    assert r.apply(1000, change)
    r.compact()
    assert total() == [("a", "en", "t", 1002, 2004)] and r.committed() == [-3] and r.seen(0) and r.seen(1000)
    r.vacuum()
    assert total() == [("a", "en", "t", 1002, 2004)] and sum(not x.startswith(".") for x in os.listdir(f"{local}/sums")) == 1
