"""Stored relations: their fields and Spark types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Identity columns.
IDENTITY = ("corpus", "source", "native_id", "origin_uri", "revision", "generation")
NUMBERS = {"line", "lines", "tokens", "start_line", "end_line", "ordinal", "generation", "current", "step"}

#: Names of relations and of their fields after the identity columns, where a relation has these.
FIELDS: dict[str, tuple[bool, tuple[str, ...]]] = {
    "handle": (True, ("id", "kind", "status", "namespace", "file", "line", "date", "area", "summary")),
    "edge": (True, ("from", "to", "kind", "file", "line", "assertion_date", "assertion_revision")),
    "meta": (True, ("handle", "key", "value", "role")),
    "content": (True, ("handle", "span_id", "lines", "text", "tokens")),
    "span": (True, ("id", "handle", "start_line", "end_line", "summary")),
    "concern": (True, ("name", "member")),
    "config": (False, ("corpus", "key", "value", "ordinal")),
    "snapshot": (False, ("corpus", "snapshot", "at", "id", "key", "value")),
    "generation": (False, ("corpus", "source", "current")),
    "trail": (False, ("session_id", "step", "timestamp", "actor", "corpus", "verb", "redacted_expr", "input_hash", "prelude_hash", "visibility", "retention")),
    "trail_ref": (False, ("session_id", "step", "kind", "ordinal", "corpus", "source", "handle", "span_id", "score")),
    "trail_generation": (False, ("session_id", "step", "corpus", "source", "generation")),
    "git_mtimes": (False, ("file", "instant")),
}


def fields(relation: str) -> tuple[str, ...]:
    identity, own = FIELDS[relation]
    return (*IDENTITY, *own) if identity else own


def schema(relation: str) -> T.StructType:
    kind = lambda c: T.DoubleType() if c == "score" else T.LongType() if c in NUMBERS else T.StringType()
    return T.StructType([T.StructField(c, kind(c)) for c in fields(relation)])


def conform(relation: str, df: DataFrame) -> DataFrame:
    """df with exactly the relation's columns and types; columns it lacks are null (identity: empty text)."""
    out = []
    for f in schema(relation).fields:
        if f.name in df.columns:
            out.append(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name))
        elif f.name in IDENTITY:
            out.append(F.lit(0 if f.name == "generation" else "").cast(f.dataType).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*out)


def rows(spark: SparkSession, relation: str, records: list[dict]) -> DataFrame:
    """A relation from dictionaries. Text identity columns default to empty, other fields to null."""
    kinds = schema(relation)
    default = lambda f: (0 if f.name == "generation" else "") if f.name in IDENTITY else None
    return spark.createDataFrame([tuple(r.get(f.name, default(f)) for f in kinds.fields) for r in records], kinds)
