"""Facts on disk: full and incremental batches, snapshot history, and rows out."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema

MOST_SNAPSHOTS = 100
#: Rows of snapshots that one task holds, about.
TASK_ROWS = 250_000
#: Handle fields that a snapshot keeps.
KEPT = ("kind", "status", "namespace", "file", "date", "area", "summary")


class DuplicateHandle(ValueError):
    """A batch that would leave two handles of one id in a corpus. Nothing of it is merged."""


def merge(relations: dict[str, DataFrame], batch: dict[str, DataFrame], corpus: str, source: str, *, delta: bool = False, retracted: DataFrame | None = None) -> dict[str, DataFrame]:
    """The relations after a batch of one (corpus, source). A full batch replaces all rows of the pair; a delta
    replaces the rows of its native ids and takes out those of `retracted` (native_id)."""
    out = dict(relations)
    own = (F.col("corpus") == corpus) & (F.col("source") == source)
    for name in set(batch) | ({n for n in relations if schema.FIELDS[n][0]} if not delta or retracted is not None else set()):
        old = relations.get(name)
        new = batch.get(name)
        if new is not None:
            new = schema.conform(name, new).withColumns({"corpus": F.lit(corpus), "source": F.lit(source)})
        if old is not None and delta:
            gone = new.select("native_id") if new is not None else None
            if retracted is not None:
                gone = retracted.select("native_id") if gone is None else gone.union(retracted.select("native_id"))
            mark = gone.distinct().select(F.col("native_id").alias("_gone"))
            old = old.join(mark, own & (F.col("native_id") == F.col("_gone")), "left_anti")
        elif old is not None:
            old = old.where(~own)
        out[name] = new if old is None else old if new is None else old.unionByName(new.select(*old.columns))
    if "handle" in batch:
        twice = out["handle"].groupBy("corpus", "id").count().where("count > 1").first()
        if twice:
            raise DuplicateHandle(f"{twice.id} occurs {twice['count']} times in corpus {twice.corpus!r}")
    known = relations.get("generation")
    row = schema.rows(out["handle"].sparkSession, "generation", [{"corpus": corpus, "source": source, "current": 1}]) if "handle" in out else None
    if row is not None:
        both = row if known is None else known.unionByName(row)
        out["generation"] = both.groupBy("corpus", "source").agg(F.sum("current").alias("current"))
    return out


# Snapshot history as lines of JSON: {"snapshot", "at", "corpus", "id", "key", "value"}


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Snapshot rows, and the lines that are none (with column `line`)."""
    kinds = schema.schema("snapshot").add("_bad", "string")
    rows = spark.read.schema(kinds).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    bad = F.col("_bad").isNotNull() | F.col("snapshot").isNull() | F.col("at").isNull()
    return rows.where(~bad).select(*schema.fields("snapshot")), rows.where(bad).select(F.coalesce("_bad", F.to_json(F.struct(*schema.fields("snapshot")))).alias("line"))


def state(handle: DataFrame) -> DataFrame:
    """Rows (corpus, id, key, value) of the fields a snapshot keeps."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in KEPT])
    return handle.select("corpus", "id", F.explode(pairs).alias("e")).select("corpus", "id", "e.key", "e.value").where("value is not null")


def take_snapshot(handle: DataFrame, history: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """History with a snapshot of the handles, unless the last one has the same state; only the latest
    MOST_SNAPSHOTS snapshots stay."""
    at = at or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    # Dealt by handle, into as many partitions as the rows need: none has more than TASK_ROWS, about.
    parts = max(int(handle.sparkSession.conf.get("spark.sql.shuffle.partitions")), handle.count() * len(KEPT) // TASK_ROWS + 1)
    now = state(handle.select("corpus", "id", *KEPT).repartition(parts, "corpus", "id")).distinct()
    last = history.select("snapshot", "at").distinct().orderBy(F.desc("at"), F.desc("snapshot")).first()
    if last:
        before = history.where(F.col("snapshot") == last.snapshot).select("corpus", "id", "key", "value")
        both = state(handle).withColumn("now", F.lit(True)).union(before.withColumn("now", F.lit(False))).repartition(parts, "corpus", "id")
        # One grouping finds rows of only one of them.
        if both.groupBy("corpus", "id", "key", "value").agg(F.min("now").alias("a"), F.max("now").alias("b")).where("a = b").isEmpty():
            return history
    fresh = now.select("corpus", F.lit(name).alias("snapshot"), F.lit(at).alias("at"), "id", "key", "value")
    both = history.select(*fresh.columns).union(fresh)
    kept = both.select("snapshot", "at").distinct().orderBy(F.desc("at"), F.desc("snapshot")).limit(MOST_SNAPSHOTS).select("snapshot")
    return both.join(F.broadcast(kept), "snapshot").select(*fresh.columns)


def write_history(history: DataFrame, path: str) -> None:
    history.write.mode("overwrite").json(path)


def write_rows(df: DataFrame, path: str, form: str = "ndjson") -> None:
    """Rows of a query as ndjson, json, csv, text (tab separated) or parquet. Nulls are written."""
    if form == "ndjson":
        df.write.option("ignoreNullFields", "false").json(path)
    elif form == "json":
        df.write.option("ignoreNullFields", "false").json(path)
    elif form == "text":
        df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in df.columns]).alias("value")).write.text(path)
    else:
        df.write.format(form).save(path)
