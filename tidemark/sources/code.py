"""Source trees as facts: one handle a file, its class and language, and notes left in comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schema
from .markdown import CODE_EXTENSIONS

#: Folders that are not scanned, and what marks a file as a test or as generated.
IGNORED = ("_build", "target", "node_modules", ".git")
TEST = r"(^|/)(tests?|spec)/|(^|/)test_[^/]*$|_(test|spec)\.[a-z]+$"
GENERATED = r"(?i)(@generated|code generated .{0,40} do not edit|autogenerated)"
NOTE = r"\b(TODO|FIXME|XXX)\b[:( ]*([^\n]{0,200})"


def extract(files: DataFrame, *, corpus: str = "", source: str = "code") -> dict[str, DataFrame]:
    """handle, meta, content and span of (path, text), with column expressions only."""
    ext = F.substring_index("path", ".", -1)
    ignored = F.col("path").rlike("(^|/)(" + "|".join(x.replace(".", "[.]") for x in IGNORED) + ")/")
    files = files.where(ext.isin(*sorted(CODE_EXTENSIONS)) & ~ignored)
    base = {"corpus": F.lit(corpus), "source": F.lit(source), "revision": F.lit("")}
    area = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(F.lit("(root)"))
    head = F.substring("text", 1, 2000)
    kind = F.when(head.rlike(GENERATED), "generated").when(F.col("path").rlike(TEST), "test").otherwise("public")
    handle = files.select(F.col("path").alias("id"), F.lit("file").alias("kind"), kind.alias("status"), F.lit("").alias("namespace"), F.col("path").alias("file"), F.lit(1).cast("long").alias("line"), area.alias("area"), F.lit("").alias("summary"), F.col("path").alias("native_id")).withColumns(base)
    facts = F.array(F.struct(F.lit("code.class").alias("key"), kind.alias("value")), F.struct(F.lit("code.language").alias("key"), ext.alias("value")))
    meta = files.select(F.col("path").alias("handle"), F.explode(facts).alias("e")).select("handle", "e.key", "e.value")
    notes = files.select(F.col("path").alias("handle"), F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.col("line").rlike(NOTE))
    said = notes.select("handle", F.concat(F.lit("code.note."), F.lower(F.regexp_extract("line", NOTE, 1))).alias("key"), F.concat_ws(": ", (F.col("n") + 1).cast("string"), F.trim(F.regexp_extract("line", NOTE, 2))).alias("value"))
    meta = meta.union(said).withColumn("role", F.lit("derived")).withColumns(base)
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).cast("long")
    lines = F.size(F.split("text", "\n", -1)).cast("long")
    content = files.select(F.col("path").alias("handle"), F.concat("path", F.lit("#full")).alias("span_id"), lines.alias("lines"), "text", words.alias("tokens")).withColumns(base)
    span = content.select(F.col("span_id").alias("id"), "handle", F.lit(1).cast("long").alias("start_line"), F.col("lines").alias("end_line"), F.lit("").alias("summary")).withColumns(base)
    return {k: schema.conform(k, df) for k, df in {"handle": handle, "meta": meta, "content": content, "span": span}.items()}
