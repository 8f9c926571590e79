r"""WARC archives: writing pages as transactions, reading records, assembling one nested row per capture.

write_pages() stores each page as a request, a response or revisit, and a metadata record; the latter two
name the response through WARC-Concurrent-To. Spark's own text writer makes the files (a record ends in
CRLF CRLF, which is its line separator), so any file system Spark can write will do. A file holds payloads of
`file_bytes` bytes at most, or one capture: pages are written by classes of size, each with its number of records a
file. read_records() parses archives, plain or gzip (one member or one a record), record by record from a stream
that is unpacked as it is read; a task holds one packed file (Spark reads files below 2 GB), one record and one batch of
rows. assemble() joins request, response and metadata records through their concurrent-to identifiers in either
direction.

Of pages with equal payloads of at least `revisit_bytes` bytes, the one with the largest page_id is a response
and the others revisit it (profile identical-payload-digest).

Defined cases: null html is an empty payload; null url or page_id leave out their fields; among rows repeating
the largest page_id of a payload all are responses; a null page_id revisits any page that has one; a
malformed archive raises an error; requests and metadata without a response make captures without one; an
empty table writes and reads no records; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import io

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ._shared import new_path, written

REVISIT_BYTES = 1000
FILE_BYTES = 128 << 20
#: Captures a file of pages of each class of size.
_CAPTURES = (2000, 128, 8, 1)
_BATCH_ROWS, _BATCH_BYTES = 1000, 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "record_id string, type string, uri string, date string, concurrent_to array<string>, digest string, headers map<string,string>, http string, payload binary"


def _header(name: str, value):
    """A header line, or nothing for a null value. Line breaks inside a value are escaped."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A"), F.lit("\r\n")), F.lit(""))


def _record(kind, record_id, uri, date: str, block, mime: str, *more):
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", record_id),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", uri),
        *more,
        _header("Content-Type", F.lit(mime)),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_pages(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", revisit_bytes: int = REVISIT_BYTES, compression: str = "gzip", file_bytes: int = FILE_BYTES) -> None:
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html")).withColumns({"digest": F.sha1("html"), "bytes": F.octet_length("html").cast("long")})
    longest = Observation()
    same = rows.observe(longest, F.max("bytes").alias("bytes")).where(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("kept")).where("n > 1")
    # Written first, so that its size is known: a small table is broadcast, a large one is shuffled.
    same = written(same.select("digest", "kept"), "payloads")
    again = F.col("kept").isNotNull() & F.col("kept.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept.page_id"))
    urn = lambda: F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))
    rows = rows.join(same, "digest", "left").withColumns({"again": again, "main": urn(), "asked": urn(), "about": urn()})

    digest = _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    host, target = F.regexp_extract("url", r"^[a-zA-Z]+://([^/\s]+)", 1), F.regexp_extract("url", r"^[a-zA-Z]+://[^/\s]+([^\s#]*)", 1)
    ask = F.concat(F.lit("GET "), F.coalesce(F.when(target != "", target), F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit("\r\n\r\n"))
    fields = F.concat(_header("page-id", F.col("page_id").cast("string")), F.lit("fetchTimeMs: 0\r\n"))
    together = _header("WARC-Concurrent-To", F.col("main"))
    profile = F.when(F.col("again"), F.concat(_header("WARC-Profile", F.lit(PROFILE)), _header("WARC-Refers-To-Target-URI", F.col("kept.url")), _header("WARC-Refers-To-Date", F.lit(date)))).otherwise("")
    records = F.array(
        _record(F.lit("request"), F.col("asked"), F.col("url"), date, ask, "application/http; msgtype=request", together),
        _record(F.when(F.col("again"), "revisit").otherwise("response"), F.col("main"), F.col("url"), date, F.when(F.col("again"), http).otherwise(F.concat(http, F.col("html"))), "application/http; msgtype=response", digest, profile),
        _record(F.lit("metadata"), F.col("about"), F.col("url"), date, fields, "application/warc-fields", together),
    )
    most, least = longest.get["bytes"] or 0, -1
    for captures in _CAPTURES:
        upto = most if captures == 1 else file_bytes // captures
        part = rows.where((F.col("bytes") > least) & (F.col("bytes") <= upto)).select(F.explode(records).alias("value"))
        part.write.mode("append").option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", 3 * captures).text(path)
        least = upto
        if upto >= most:
            break


def parse(data: bytes):
    """(headers, block) of each record, read as a stream; header names are lowered, concurrent-to values are a list."""
    raw = io.BytesIO(data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == b"\x1f\x8b" else raw
    n = 0
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record after {n} records")
        headers: dict = {"warc-concurrent-to": []}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"truncated WARC record after {n} records")
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(":")
            if name.lower() == "warc-concurrent-to":
                headers["warc-concurrent-to"].append(value.strip())
            else:
                headers[name.lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"truncated WARC record after {n} records")
        yield headers, block
        n += 1


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: identifiers, headers, and of HTTP records the header and the payload apart."""
    s = pa.string()
    kinds = (s, s, s, s, pa.list_(s), s, pa.map_(s, s), s, pa.binary())
    names = ["record_id", "type", "uri", "date", "concurrent_to", "digest", "headers", "http", "payload"]

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)  # noqa: B023, E731
                for h, block in parse(content.as_py()):
                    http, payload = None, block
                    if h.get("content-type", "").startswith("application/http"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        http = head.decode("utf-8", "replace")
                    digest = h.get("warc-payload-digest")
                    plain = [(k, v) for k, v in h.items() if k != "warc-concurrent-to"]
                    rows.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), h["warc-concurrent-to"], digest and digest.removeprefix("sha1:"), plain, http, payload))
                    held += len(block)
                    if len(rows) >= _BATCH_ROWS or held >= _BATCH_BYTES:
                        yield made()
                        rows, held = [], 0
                if rows:
                    yield made()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path)
    return files.select("content").mapInArrow(read, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, response (a response or revisit, null if there is none), requests and
    metadata (arrays). All columns of records are inside the nested rows. Identifiers are read several times, so
    records should be a table, not a scan of archives."""
    whole = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    main = F.col("type").isin("response", "revisit")
    links = records.select("record_id", main.alias("main"), F.explode_outer("concurrent_to").alias("to"))
    responses = links.where("main")
    # Every name of a capture: its response, what the response points to, what points to the response.
    names = responses.select(F.col("record_id").alias("name"), F.col("record_id").alias("capture"))
    names = names.union(responses.where("to is not null").select("to", "record_id"))
    others = links.where("not main")
    ids = responses.select(F.col("record_id").alias("to")).distinct()
    names = names.union(others.join(ids, "to").select("record_id", "to"))
    names = written(names.groupBy("name").agg(F.min("capture").alias("capture")), "captures")
    direct = others.join(names, others.record_id == names["name"], "left").select("record_id", "to", F.col("capture").alias("c1"))
    via = names.select(F.col("name").alias("to"), F.col("capture").alias("c2"))
    placed = direct.join(via, "to", "left").groupBy("record_id").agg(F.coalesce(F.min("c1"), F.min("c2"), F.min("to"), F.col("record_id")).alias("capture_id"))
    placed = written(placed.union(responses.select("record_id", "record_id").distinct()), "placed")
    rows = records.withColumn("_td_row", whole).select("record_id", "type", "_td_row").join(placed, "record_id")
    pick = lambda c: F.when(c, F.col("_td_row"))
    return rows.groupBy("capture_id").agg(F.first(pick(main), ignorenulls=True).alias("response"), F.collect_list(pick(F.col("type") == "request")).alias("requests"), F.collect_list(pick(F.col("type") == "metadata")).alias("metadata"))


def warc_fields(payload):
    """A map of the fields of an application/warc-fields payload."""
    lines = F.filter(F.split(F.decode(payload, "utf-8"), "\r\n"), lambda x: F.contains(x, F.lit(": ")))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), F.regexp_replace(x, r"^[^:]*: ", "").alias("v"))))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archive")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = read_records(spark, path)
    # Digest and size of what was read; pages' payloads need not travel on.
    slim = records.select("record_id", "type", "concurrent_to", "digest", F.when(F.col("type") == "metadata", warc_fields(F.col("payload"))["page-id"].cast("long")).alias("page_id"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    # assemble() reads its records several times: parse the archives once.
    slim = written(slim, "records")
    captures = written(assemble(slim).select(F.col("response.type").alias("record_type"), F.col("response.digest").alias("digest"), F.col("response.sha1").alias("sha1"), F.col("response.bytes").alias("bytes"), F.col("metadata")[0]["page_id"].alias("page_id")), "assembled")
    kept = captures.where(F.col("record_type") == "response").groupBy("sha1").agg(F.max("page_id").alias("kept_id"), F.max("bytes").alias("kept_bytes"))
    kept = kept.join(captures.where("record_type = 'revisit'").select(F.col("digest").alias("sha1")).distinct(), "sha1", "left_semi")
    kept = written(kept, "kept")
    plain = captures.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = captures.where("record_type = 'revisit'").join(kept, captures.digest == kept["sha1"], "left").select("page_id", F.col("kept_bytes").alias("payload_bytes"), "digest", "record_type", F.col("kept_id").alias("refers_to"))
    return plain.union(again)


OP2_SQL = f"""
SELECT page_id, bytes AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN bytes >= {REVISIT_BYTES} AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= {REVISIT_BYTES} AND page_id <> kept THEN kept END AS refers_to
FROM (SELECT page_id, html, CAST(strlen(html) AS BIGINT) AS bytes, max(page_id) OVER (PARTITION BY html) AS kept FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))
"""
