"""Status, pipeline, obligation and recency primitives over handles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import day_of

#: A status containing one of these, in lower case, is terminal unless configured active.
TERMINAL_HEURISTICS = (
    "superseded", "archived", "historical", "prior", "retired", "deprecated", "obsolete", "withdrawn",
    "cancelled", "canceled", "closed", "resolved", "done", "completed", "incorporated", "digested",
)
#: Statuses settled where none are configured, and the pipeline where none is.
SETTLED = ("authoritative", "current", "active", "stable", "living")
PIPELINE = ("raw", "draft", "research", "plan", "current", "active", "stable", "authoritative")


def settings(ctx) -> dict[str, list]:
    """Values of each configuration key with their ordinals. The driver reads a configuration once and whole, each
    different row once, and it becomes literals of plans."""
    held = getattr(ctx, "_settings", None)
    if held is None or held[0] is not ctx.version:
        rows = ctx.relation("config").select("key", "value", "ordinal").distinct().orderBy("key", "ordinal", "value").collect()
        found: dict[str, list] = {}
        for r in rows:
            found.setdefault(r.key, []).append((r.value, r.ordinal))
        held = ctx._settings = (ctx.version, found)
    return held[1]


def values(ctx, key: str) -> list[str]:
    return sorted({v for v, _ in settings(ctx).get(key, []) if v is not None})


def _in(c: Column, items) -> Column:
    return F.coalesce(c.isin(*items), F.lit(False)) if items else F.lit(False)


def is_terminal(ctx, status: Column) -> Column:
    """Configured so, or not configured active and of a name that says so; null is not terminal."""
    guess = F.coalesce(F.lower(status).rlike("|".join(TERMINAL_HEURISTICS)), F.lit(False))
    return _in(status, values(ctx, "convergence.terminal")) | (~_in(status, values(ctx, "convergence.active")) & guess)


def is_settled(ctx, status: Column) -> Column:
    return _in(status, values(ctx, "convergence.settled") or SETTLED)


def handles(ctx) -> DataFrame:
    return ctx.relation("handle")


def _ids(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("p0")).distinct()


def terminal(ctx) -> DataFrame:
    return _ids(handles(ctx).where(is_terminal(ctx, F.col("status"))))


def active(ctx) -> DataFrame:
    return _ids(handles(ctx).where(~is_terminal(ctx, F.col("status"))))


def settled(ctx) -> DataFrame:
    return _ids(handles(ctx).where(is_settled(ctx, F.col("status"))))


def places(ctx) -> list[tuple[str, int, str]]:
    """(status, ordinal, origin): the configured ordering, or the built-in one where none is configured. A
    status named twice keeps its first place."""
    own: dict[str, int] = {}
    for v, n in settings(ctx).get("convergence.ordering", []):
        if n is not None:
            own[v] = min(n, own.get(v, n))
    if own:
        return [(s, n, "project") for s, n in own.items()]
    return [(s, n, "builtin") for n, s in enumerate(PIPELINE)]


def classification(ctx) -> DataFrame:
    """(status, classification, origin) over statuses used, configured and built in."""
    keys = [f"convergence.{k}" for k in ("ordering", "active", "terminal", "settled")]
    named = {*SETTLED, *PIPELINE, *(v for k in keys for v in values(ctx, k))}
    known = handles(ctx).where("status is not null").select("status").distinct().union(ctx.local([(s,) for s in sorted(named)], "status string")).distinct()
    status = F.col("status")
    origin = lambda c: F.when(c, "project").otherwise("builtin")
    row = lambda c, o: F.struct(F.lit(c).alias("c"), o.alias("o"))
    own = _in(status, values(ctx, "convergence.terminal"))
    dead = is_terminal(ctx, status)
    placed = places(ctx)
    rows = F.array(
        F.when(dead, row("terminal", origin(own))),
        F.when(~dead & _in(status, values(ctx, "convergence.active")), row("active", F.lit("project"))),
        F.when(is_settled(ctx, status), row("settled", F.lit("project" if values(ctx, "convergence.settled") else "builtin"))),
        F.when(_in(status, [s for s, _, _ in placed]), row("pipeline", F.lit(placed[0][2]))),
    )
    found = known.select("status", F.explode(F.array_compact(rows)).alias("r"))
    return found.select(F.col("status").alias("p0"), F.col("r.c").alias("p1"), F.col("r.o").alias("p2"))


def pipeline_position(ctx) -> DataFrame:
    place = F.create_map(*[F.lit(x).cast("long") if isinstance(x, int) else F.lit(x) for s, n, _ in places(ctx) for x in (s, n)])
    rows = handles(ctx).where("status is not null").select(F.col("id").alias("p0"), F.try_element_at(place, F.col("status")).alias("p1"))
    return rows.where("p1 is not null").distinct()


def pipeline_position_for(ctx) -> DataFrame:
    return ctx.local([(s, n) for s, n, _ in places(ctx)], "p0 string, p1 long")


def obligations(ctx) -> DataFrame:
    return handles(ctx).where((F.col("kind") == "label") & _in(F.col("namespace"), values(ctx, "handles.linear")))


def obligation(ctx) -> DataFrame:
    return _ids(obligations(ctx))


def _discharges(ctx) -> DataFrame:
    return ctx.relation("edge").where("kind = 'Discharges'").select(F.col("to").alias("id")).distinct()


def discharged(ctx) -> DataFrame:
    return _ids(handles(ctx).join(_discharges(ctx), "id", "left_semi"))


def undischarged(ctx) -> DataFrame:
    return _ids(obligations(ctx).where(~is_terminal(ctx, F.col("status"))).join(_discharges(ctx), "id", "left_anti"))


def age(ctx, date: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(ctx.day) - day_of(date), F.lit(0).cast("long")), F.lit(0).cast("long"))


def freshness(ctx) -> DataFrame:
    return handles(ctx).select(F.col("id").alias("p0"), age(ctx, F.col("date")).alias("p1")).distinct()


def flux(ctx, seeds: DataFrame) -> DataFrame:
    """(h, days, delta): changes of status between consecutive snapshots of the last days, then to now."""
    days = seeds.select(F.coalesce("p1", F.lit(-1)).alias("days")).distinct()
    days = days.withColumn("days", F.when(F.col("days") < 0, F.raise_error(F.lit("flux: days is negative")).cast("long")).otherwise(F.col("days")))
    now = handles(ctx).select("id", "status", F.lit(None).cast("long").alias("day"), F.lit(None).cast("string").alias("at")).distinct()
    ids = now.select("id").distinct()
    past = ctx.relation("snapshot").where("key = 'status'").select("id", F.col("value").alias("status"), day_of(F.col("at")).alias("day"), "at").join(ids, "id", "left_semi")
    past = past.where(F.col("day") <= ctx.day).join(days, F.col("day") >= F.lit(ctx.day) - F.col("days"))
    rows = past.select("id", "days", "status", "day", "at").union(now.crossJoin(days).select("id", "days", "status", "day", "at"))
    w = Window.partitionBy("id", "days").orderBy(F.col("day").asc_nulls_last(), F.col("at").asc_nulls_last(), F.col("status").asc_nulls_first())
    moved = F.when(F.row_number().over(w) > 1, (~F.col("status").eqNullSafe(F.lag("status").over(w))).cast("long")).otherwise(0)
    return rows.withColumn("moved", moved).groupBy(F.col("id").alias("p0"), F.col("days").alias("p1")).agg(F.sum("moved").alias("p2"))


def git_mtime(ctx) -> DataFrame:
    return ctx.relation("git_mtimes").select(F.col("file").alias("p0"), F.col("instant").alias("p1")).distinct()


def changed_within(ctx, seeds: DataFrame) -> DataFrame:
    days = seeds.select(F.col("p1").alias("days")).distinct()
    touched = ctx.relation("git_mtimes").select("file", day_of(F.col("instant")).alias("day")).groupBy("file").agg(F.max("day").alias("day"))
    rows = handles(ctx).select("id", "file").join(touched, "file")
    return rows.join(days, F.col("day") >= F.lit(ctx.day) - F.col("days")).select(F.col("id").alias("p0"), F.col("days").alias("p1")).distinct()
