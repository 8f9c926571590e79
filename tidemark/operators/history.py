"""Point-in-time views: the current handles with a snapshot's values laid over them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import day, day_of

PATCHED = ("kind", "status", "namespace", "file", "date", "area", "summary")


class NoSnapshot(LookupError):
    """A time reference that names no snapshot."""


def resolve(snapshot: DataFrame, ref: str, today: int) -> tuple[str, int]:
    """(id, day) of the snapshot that ref names: snapshot:last, snapshot:<id>, a date or instant (the nearest,
    the later of two as near), or --<n>days."""
    known = snapshot.select("snapshot", "at").distinct().withColumn("day", day_of(F.col("at"))).where("day is not null")
    last = [F.desc("day"), F.desc("at"), F.desc("snapshot")]
    ago = re.fullmatch(r"--(\d+)days", ref)
    if ref == "snapshot:last":
        found = known.orderBy(*last)
    elif ref.startswith("snapshot:"):
        found = known.where(F.col("snapshot") == ref.removeprefix("snapshot:")).orderBy(*last)
    elif ago or day(ref) is not None:
        target = today - int(ago[1]) if ago else day(ref)
        found = known.orderBy(F.abs(F.col("day") - F.lit(target)), *last)
    else:
        raise NoSnapshot(f"{ref!r} is no time reference")
    row = found.first()
    if row is None:
        raise NoSnapshot(f"no snapshot for {ref!r}")
    return row.snapshot, row.day


def overlay(handle: DataFrame, snapshot: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Handles patched by (corpus, id), none invented, and the snapshot's own rows."""
    own = snapshot.where(F.col("snapshot") == name)
    patch = own.groupBy("corpus", "id").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"new_{k}") for k in PATCHED])
    joined = handle.join(patch, ["corpus", "id"], "left")
    columns = [F.coalesce(f"new_{c}", c).alias(c) if c in PATCHED else F.col(f"`{c}`") for c in handle.columns]
    return joined.select(*columns), own
