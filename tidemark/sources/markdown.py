"""Markdown documents as facts: front matter, headings, links, labels and paths.

Input is a table (path, text), for instance from spark.read.text(..., wholetext=True). One pass over the texts
yields flat items; everything between documents (which prefixes are namespaces, what a reference means, versions)
is joins and aggregates over them.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frontmatter, schema

#: Patterns of references in bodies.
LABEL = re.compile(r"([A-Z][A-Z_]*(?:-[A-Z][A-Z_]*)*)-(\d+)")
SECTION = re.compile(r"§(\d+(?:\.\d+)*)")
FILE = re.compile(r"([a-z0-9_/-]+\.md)\b")
CODE = re.compile(r"(?P<path>[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+)(?::(?P<start>\d+)(?:-(?P<end>\d+))?(?::\d+)?)?")
LINK = re.compile(r"\[([^\[\]]*)\]\(\s*<?([^()\s>]+)>?[^()]*\)")
#: Words of a line that make its references dependencies.
DEPENDING = ("incorporates", "builds on", "extends")
#: First folders of a path that is taken for code.
CODE_ROOTS = ("crates", "lib", "src", "app", "test", "priv", "native")
#: First folders of a path that is never taken for code.
EXCLUDED_ROOTS = ("_build", "target", "node_modules")
#: File name extensions of code.
CODE_EXTENSIONS = {
    "agda", "c", "cc", "cpp", "cs", "css", "ex", "exs", "go", "h",
    "hpp", "hs", "java", "js", "jsx", "kt", "lean", "lua", "m", "mm",
    "php", "py", "rb", "rs", "scala", "sh", "sql", "swift", "ts", "tsx",
}
#: Front matter fields that make edges, with the kind and whether the edge is turned round.
FIELDS = {"superseded-by": ("Supersedes", False), "depends-on": ("DependsOn", False), "discharges": ("Discharges", False), "verifies": ("Verifies", False), "supersedes": ("Supersedes", True), "affects": ("DependsOn", True), "references": ("Cites", False)}

_ITEM = "path string, what string, a string, b string, kind string, line long, until long, inverse boolean"
_NAMES = ["path", "what", "a", "b", "kind", "line", "until", "inverse"]


#: What opens and closes a code block, what opens a list item, and what underlines a heading.
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_LISTED = re.compile(r"\s*(?:[-*+]|\d{1,9}[.)])(?:\s|$)")
_ATX = re.compile(r" {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_QUOTE = re.compile(r"^(?: {0,3}> ?)+")
_TICKS = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)")
_WIKI = re.compile(r"\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:|//")
_BEFORE_CODE = re.compile(r"[/:.\-_#@A-Za-z0-9]$")


def blocks(lines: list[str], skip: int):
    """(line of the block, whether it is a heading, [(line, text)]) of the blocks of text after the first lines: paragraphs,
    list items, table rows and headings. Code blocks, fenced or indented, are left out."""
    held: list[tuple[int, str]] = []
    fence, listed, after_blank, plain, quoted = "", False, True, False, False
    for n, line in enumerate(lines[skip:], skip + 1):
        line = line.rstrip("\r")
        if fence:
            m = _FENCE.match(line)
            if m and m[1].startswith(fence) and not line.strip().strip(fence[0]):
                fence, after_blank = "", True
            continue
        text = _QUOTE.sub("", line)
        was_quoted, quoted = quoted, text != line
        opens, heading, row = _FENCE.match(text), _ATX.match(text), text.lstrip().startswith("|")
        # Underlined paragraphs are headings; under anything else the line is a rule.
        if _UNDERLINE.match(text) and (held or text.lstrip()[0] == "-"):
            if held:
                yield held[0][0], plain and quoted == was_quoted, held
            held, after_blank = [], True
            continue
        indented = not held and after_blank and not listed and text.startswith(("    ", "\t"))
        item = _LISTED.match(text)
        if held and (opens or heading or item or row or not text.strip() or quoted > was_quoted):
            yield held[0][0], False, held
            held = []
        if opens:
            fence = opens[1]
        elif heading:
            listed, after_blank = False, True
            yield n, True, [(n, heading[1] or "")]
        elif not text.strip():
            after_blank = True
        elif not indented:
            if item:
                listed = True
            elif after_blank and not text.startswith(" "):
                listed = False
            if not held:
                plain = not item and not row and not listed
            after_blank = False
            held.append((n, text))
    if held:
        yield held[0][0], False, held


def _code_paths(text: str, roots: tuple[str, ...]):
    """Matches of paths to code: below a known folder, not inside a longer word or address."""
    for m in CODE.finditer(text):
        path, before = m["path"], text[: m.start()]
        root, ext = path.split("/")[0], path.rsplit(".", 1)[-1].lower()
        if root in roots and root not in EXCLUDED_ROOTS and ext in CODE_EXTENSIONS and "..." not in path and not _BEFORE_CODE.search(before):
            yield m


def _references(text: str, line: int, roots: tuple[str, ...]):
    """The text that is left to be searched, and the references of links and code spans in it as items."""
    out = []

    def code(m) -> str:
        out.extend(_code_item(c, line) for c in _code_paths(m[2], roots))
        return ""

    def wiki(m) -> str:
        out.append(("ref", m[1].strip(), "wiki", "Cites", line, None, False))
        return m[2] if m[2] is not None else ""

    def link(m) -> str:
        target = m[2].split("#")[0]
        if target and not _SCHEME.match(m[2]):
            paths = [c for c in _code_paths(target, roots) if c[0] == target]
            out.extend([_code_item(paths[0], line)] if paths else [("ref", target, "link", "Cites", line, None, False)])
        return m[1]

    return LINK.sub(link, _WIKI.sub(wiki, _TICKS.sub(code, text))), out


def _code_item(m, line: int) -> tuple:
    return "code", m["path"], m["start"] or "", "Cites", line, int(m["end"] or m["start"] or 0), False


def items(path: str, text: str, roots: tuple[str, ...] = CODE_ROOTS):
    """(what, a, b, kind, line, until, inverse) of one document. The line of a reference is that of its block, that of a
    link or code span its own."""
    lines = text.split("\n")
    front, skip = frontmatter.split(lines)
    for key, values in frontmatter.parse(front).items():
        for v in values:
            yield "meta", key, v, "authored_modeled" if key in FIELDS or key in ("status", "date", "updated", "title") else "authored_unmodeled", 1, None, None
            if key in FIELDS:
                yield "ref", v, "front", FIELDS[key][0], 1, None, FIELDS[key][1]
    heads = []
    for start, heading, inside in blocks(lines, skip):
        title = []
        for n, line in inside:
            rest, found = _references(line, n, roots)
            yield from found
            title.append(rest.strip())
            kind = "DependsOn" if any(k in rest.lower() for k in DEPENDING) else "Cites"
            for m in LABEL.finditer(rest):
                yield "label", f"{m[1]}-{int(m[2])}", m[1], "definition" if heading else kind, start, int(m[2]), False
            for m in SECTION.finditer(rest):
                yield "ref", f"section:{m[1]}", "section", kind, start, None, False
            for m in FILE.finditer(rest):
                yield "ref", m[1], "path", kind, start, None, False
            for m in _code_paths(rest, roots):
                yield _code_item(m, start)
        if heading and " ".join(title).strip():
            heads.append((start, " ".join(title).strip()))
    body = "\n".join(lines[skip:])
    yield "body", body, "", "", skip + 1, len(lines), None
    for i, (n, title) in enumerate(heads):
        end = heads[i + 1][0] - 1 if i + 1 < len(heads) else len(lines)
        slug = re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-")
        yield "heading", title, slug, "\n".join(lines[n - 1 : end]), n, end, None


def _parser(roots: tuple[str, ...]):
    def parse(batches):
        for batch in batches:
            texts = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            rows = [(path, *item) for path, text in texts for item in items(path, text or "", roots)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.string()] * 5 + [pa.int64()] * 2 + [pa.bool_()])], names=_NAMES)

    return parse


def namespaces(found: DataFrame, force: list[str], rejected: list[str]) -> DataFrame:
    """Label prefixes that are namespaces: three numbers in two files at least; if all are over 100, three of
    them in a row."""
    labels = found.where("what = 'label'").select(F.col("b").alias("namespace"), F.col("until").alias("n"), "path").distinct()
    w = Window.partitionBy("namespace").orderBy("n")
    runs = labels.select("namespace", "n").distinct().withColumn("island", F.col("n") - F.row_number().over(w)).groupBy("namespace", "island").agg(F.count("*").alias("run"))
    runs = runs.groupBy("namespace").agg(F.max("run").alias("run"))
    sums = labels.groupBy("namespace").agg(F.count_distinct("n").alias("numbers"), F.count_distinct("path").alias("files"), F.min("n").alias("low"))
    good = sums.join(runs, "namespace").where("numbers >= 3 and files >= 2 and (low <= 100 or run >= 3)").select("namespace")
    out = good.where(~F.col("namespace").isin(*rejected)) if rejected else good
    return out.union(found.sparkSession.createDataFrame([(f,) for f in force], "namespace string")).distinct()


def _normal(path):
    """A relative path without . and .. parts."""
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, x: F.when((x == ".") | (x == ""), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(parts, "/")


def extract(files: DataFrame, *, written, corpus: str = "", source: str = "markdown", force: tuple[str, ...] = (), rejected: tuple[str, ...] = (), concerns: dict[str, list[str]] | None = None, code_roots: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Relations of the documents: handle, edge, meta, content, span, concern. written: a function that stores
    a frame and reads it back. code_roots: further folders whose files are code."""
    roots = (*CODE_ROOTS, *(r.strip("/") for r in code_roots))
    found = written(files.select("path", "text").mapInArrow(_parser(roots), _ITEM))
    spark = files.sparkSession
    base = {"corpus": F.lit(corpus), "source": F.lit(source), "revision": F.lit(""), "generation": F.lit(0).cast("long")}
    area = F.when(F.contains("file", F.lit("/")), F.substring_index("file", "/", 1)).otherwise(F.lit("(root)"))
    value = lambda key: F.max(F.when(F.col("a") == key, F.col("b")))

    front = found.where("what = 'meta'").groupBy("path").agg(value("status").alias("status"), value("updated").alias("updated"), value("date").alias("dated"), value("title").alias("title"))
    head = found.where("what = 'heading'").groupBy("path").agg(F.min_by("a", "line").alias("head"))
    docs = files.select(F.col("path").alias("id")).distinct().join(front.withColumnRenamed("path", "id"), "id", "left").join(head.withColumnRenamed("path", "id"), "id", "left")
    iso = lambda c: F.when(F.substring(c, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(c, 1, 10))
    name = F.substring_index("id", "/", -1)
    docs = docs.select("id", F.lit("file").alias("kind"), "status", F.lit("").alias("namespace"), F.col("id").alias("file"), F.lit(1).cast("long").alias("line"), F.coalesce(iso(F.col("updated")), iso(F.col("dated")), iso(name)).alias("date"), F.coalesce("title", "head", F.lit("")).alias("summary"))

    spaces = namespaces(found, list(force), list(rejected))
    uses = found.where("what = 'label'").join(spaces.withColumnRenamed("namespace", "b"), "b")
    first = F.struct((F.col("kind") != "definition").alias("mentioned"), "path", "line")
    labels = uses.groupBy(F.col("a").alias("id"), F.col("b").alias("namespace")).agg(F.min(first).alias("at"))
    labels = labels.select("id", F.lit("label").alias("kind"), F.lit(None).cast("string").alias("status"), "namespace", F.col("at.path").alias("file"), F.col("at.line").alias("line"), F.lit(None).cast("string").alias("date"), F.lit("").alias("summary"))

    stem, number = F.regexp_extract(name, r"^(.+)-v(\d+)\.md$", 1), F.regexp_extract(name, r"^(.+)-v(\d+)\.md$", 2)
    versions = docs.where(stem != "").select(F.concat(stem, F.lit("-v"), number.cast("long").cast("string")).alias("id"), F.lit("version").alias("kind"), "status", F.lit("").alias("namespace"), "file", "line", F.lit(None).cast("string").alias("date"), F.lit("").alias("summary"), stem.alias("stem"), number.cast("long").alias("number"))
    older = F.lag("id").over(Window.partitionBy("stem").orderBy("number"))
    chain = versions.withColumn("older", older).where("older is not null").select(F.col("id").alias("from"), F.col("older").alias("to"), F.lit("Supersedes").alias("kind"), "file", "line")

    code = found.where("what = 'code'").select("path", F.concat(F.col("a"), F.when(F.col("b") != "", F.concat(F.lit(":"), F.col("b"))).otherwise("")).alias("id"), F.col("a").alias("target"), "line")
    outside = code.groupBy("id").agg(F.min("path").alias("file"), F.min("line").alias("line")).select("id", F.lit("external").alias("kind"), F.lit(None).cast("string").alias("status"), F.lit("").alias("namespace"), "file", "line", F.lit(None).cast("string").alias("date"), F.lit("").alias("summary"))
    handles = docs.union(labels).union(versions.drop("stem", "number")).union(outside)
    handles = handles.withColumns({**base, "area": area, "native_id": F.col("id"), "origin_uri": F.concat(F.lit("file://"), F.col("file"))})

    # References: candidates in order of preference, the first that is a handle.
    refs = found.where("what = 'ref'").select("path", F.col("a").alias("said"), "kind", "line", "inverse", F.monotonically_increasing_id().alias("n"))
    refs = written(refs)
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "/")).otherwise(F.lit(""))
    padded = F.regexp_replace("said", r"-0+(\d)", "-$1")
    tries = F.array("said", _normal(F.concat(folder, F.col("said"))), _normal(F.col("said")), F.regexp_replace("said", "^[^/]+/", ""), padded, F.regexp_replace("said", r"-v\d+\.md$", ".md"))
    known = handles.select(F.col("id").alias("id")).distinct()
    named = refs.select("n", F.posexplode(tries).alias("rank", "id")).join(known, "id").groupBy("n").agg(F.min_by("id", "rank").alias("exact"))
    files_by_name = docs.select(F.substring_index("id", "/", -1).alias("said"), "id").groupBy("said").agg(F.count("*").alias("k"), F.min("id").alias("only")).where("k = 1")
    solved = refs.join(named, "n", "left").join(files_by_name, "said", "left").withColumn("target", F.coalesce("exact", "only", "said"))
    turned = F.col("inverse")
    edges = solved.select(F.when(turned, F.col("target")).otherwise(F.col("path")).alias("from"), F.when(turned, F.col("path")).otherwise(F.col("target")).alias("to"), "kind", F.col("path").alias("file"), "line")
    mentions = uses.where("kind <> 'definition'").select(F.col("path").alias("from"), F.col("a").alias("to"), "kind", F.col("path").alias("file"), "line")
    cites = code.select(F.col("path").alias("from"), F.col("id").alias("to"), F.lit("Cites").alias("kind"), F.col("path").alias("file"), "line")
    edges = edges.union(mentions).union(cites).union(chain.select("from", "to", "kind", "file", "line")).where(~F.col("from").eqNullSafe(F.col("to"))).distinct()
    edges = edges.withColumns({**base, "native_id": F.concat_ws("|", "from", "to", "kind", F.col("line").cast("string")), "origin_uri": F.concat(F.lit("file://"), F.col("file"))})

    meta = found.where("what = 'meta'").select(F.col("path").alias("handle"), F.col("a").alias("key"), F.col("b").alias("value"), F.col("kind").alias("role"))
    parent = F.when(F.contains("id", F.lit("/")), F.regexp_replace("id", "/[^/]*$", "")).otherwise(F.lit("."))
    meta = meta.union(docs.select("id", F.lit("md.parent_dir"), parent, F.lit("derived")))
    meta = meta.union(code.select("id", F.lit("external_class"), F.lit("code"), F.lit("derived"))).union(code.select("id", F.lit("target_path"), "target", F.lit("derived"))).distinct()

    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda x: x != "")).cast("long")
    body = found.where("what = 'body'").select(F.col("path").alias("handle"), F.concat("path", F.lit("#full")).alias("span_id"), (F.col("until") - F.col("line") + 1).alias("lines"), F.col("a").alias("text"), words(F.col("a")).alias("tokens"), "line", "until", F.lit("").alias("title"))
    parts = found.where("what = 'heading'").select(F.col("path").alias("handle"), F.concat_ws("", "path", F.lit("#h/"), "b", F.lit("-"), F.col("line").cast("string")).alias("span_id"), (F.col("until") - F.col("line") + 1).alias("lines"), F.col("kind").alias("text"), words(F.col("kind")).alias("tokens"), "line", "until", F.col("a").alias("title"))
    spans = body.union(parts)
    content = spans.select("handle", "span_id", "lines", "text", "tokens").withColumns(base)
    span = spans.select(F.col("span_id").alias("id"), "handle", F.col("line").alias("start_line"), F.col("until").alias("end_line"), F.col("title").alias("summary")).withColumns(base)

    rules = spark.createDataFrame([(c, p) for c, ps in (concerns or {}).items() for p in ps], "name string, pattern string")
    starts = F.expr("pattern like '%*' and startswith(id, substring(pattern, 1, length(pattern) - 1))")
    member = rules.join(handles.select("id").distinct(), (F.col("pattern") == F.col("id")) | starts).select("name", F.col("id").alias("member")).withColumns(base)
    out = {"handle": handles, "edge": edges, "meta": meta.withColumns(base), "content": content, "span": span, "concern": member}
    return {k: schema.conform(k, df) for k, df in out.items()}
