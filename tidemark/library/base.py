"""The standard library's frame: predicates as functions of a Library, each a DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Spec:
    name: str
    params: tuple[str, ...]
    build: Callable
    axis: str
    doc: str
    protected: bool = False


REGISTRY: dict[str, Spec] = {}

#: Read by many plans, so written once instead of being planned into each of them.
SHARED = {
    "active", "terminal", "lifecycle_status_classification", "diagnostic", "entropy", "potential", "primary_entropy", "blocked", "status_broken",
    "recently_advanced", "regressed", "re_opened", "holding", "status_drifting_reason", "orientation_inbound_count", "anchor_signal", "anchor_eligible", "stale_reference", "broken_reference", "confidence_gap", "spec_code_drift", "topic_shared_target",
    "currency_superseded", "currency_disposition", "authored_age", "changed_recently", "recent_active_boost", "recent_frontier_candidate",
}


def predicate(name: str, params: str, axis: str, protected: bool = False):
    """Registers fn(library) -> DataFrame with the parameters among its columns."""

    def add(fn):
        REGISTRY[name] = Spec(name, tuple(params.split()), fn, axis, (fn.__doc__ or "").strip(), protected)
        return fn

    return add


def table(name: str, params: str, axis: str, doc: str, rows: list) -> None:
    """Registers a predicate of fixed rows."""
    names = tuple(params.split())
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    kinds = ", ".join(f"`{n}` {'long' if isinstance(v, int) else 'string'}" for n, v in zip(names, rows[0], strict=True))
    REGISTRY[name] = Spec(name, names, lambda lib: lib.ctx.local(rows, kinds), axis, doc)


class Library:
    """Named access to relations, primitives and predicates of one context; a predicate that rules define
    takes the place of the library's own everywhere."""

    def __init__(self, ctx):
        self.ctx, self.known = ctx, {}
        self.ruled = {r.name for r in ctx.program.rules}
        self.history: Library | None = None

    def rel(self, name: str, **literals) -> DataFrame:
        df = self.ctx.relation(name)
        for field, value in literals.items():
            df = df.where(F.col(field).eqNullSafe(F.lit(value)))
        return df

    def handles(self, **literals) -> DataFrame:
        return self.rel("handle", **literals).withColumnRenamed("id", "h")

    def __call__(self, name: str, *columns: str) -> DataFrame:
        """The predicate's rows, columns renamed as given or by its parameters."""
        if name not in self.known:
            df = self._plan(name)
            self.known[name] = self.ctx.shared(df) if name in SHARED else df
        df = self.known[name]
        return df.toDF(*columns) if columns else df

    def _plan(self, name: str) -> DataFrame:
        from ..plans.compiler import Catalog, Compiler

        if name in self.ruled:
            catalog = Catalog.of(self.ctx.program)
            df = Compiler(self.ctx, catalog).predicate(name)
            return df.toDF(*(REGISTRY[name].params if name in REGISTRY else catalog.params[name]))
        if name in REGISTRY:
            spec = REGISTRY[name]
            return spec.build(self).select(*spec.params).distinct()
        p = self.ctx.primitives[name]
        return p.build(self.ctx).toDF(*p.params)

    def bound(self, name: str, **given) -> DataFrame:
        """A primitive's rows with some positions bound to literals, or to each of a list."""
        p = self.ctx.primitives[name]
        at = {p.params.index(k): v for k, v in given.items()}
        seeds = self.ctx.spark.range(1).select(*[(F.explode(F.array(*map(F.lit, v))) if isinstance(v, list) else F.lit(v)).alias(f"p{i}") for i, v in sorted(at.items())])
        return p.build(self.ctx, seeds).toDF(*p.params)

    def last(self) -> Library | None:
        """The library over the last snapshot; None without history."""
        from ..operators.history import NoSnapshot

        if self.history is None:
            try:
                self.history = Library(self.ctx.at("snapshot:last"))
            except NoSnapshot:
                return None
        return self.history

    def nothing(self, kinds: str) -> DataFrame:
        return self.ctx.local([], kinds)


def counted(universe: DataFrame, keys: list[str], rows: DataFrame, value: str | list[str], out: str) -> DataFrame:
    """Distinct values per key over a universe of keys, 0 where there is none."""
    value = [value] if isinstance(value, str) else value
    n = rows.groupBy(*keys).agg(F.count_distinct(F.struct(*value)).alias(out))
    return universe.select(*keys).distinct().join(n, keys, "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def without(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    on = [on] if isinstance(on, str) else on
    return df.join(other.select(*on), on, "left_anti")


def within(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    on = [on] if isinstance(on, str) else on
    return df.join(other.select(*on), on, "left_semi")


def marked(**parts: DataFrame) -> DataFrame:
    """Each h of these frames once, with a column for each frame that says whether h is in it: one grouping of all of
    them, where a join for each would hold its sorts in the same task."""
    rows = union(*[df.select("h", *[F.lit(n == k).alias(n) for n in parts]) for k, df in parts.items()])
    return rows.groupBy("h").agg(*[F.max(n).alias(n) for n in parts])


def top(df: DataFrame, by: list[str], key: Column, ties: list[str], k: int) -> DataFrame:
    """The k rows of greatest key in each group, ties broken by ascending columns."""
    if not by:
        return df.withColumn("_key", key).orderBy(F.col("_key").desc(), *[F.col(c).asc_nulls_first() for c in ties]).limit(k).drop("_key")
    w = Window.partitionBy(*by).orderBy(key.desc(), *[F.col(c).asc_nulls_first() for c in ties])
    return df.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= k).drop("_at")


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*out.columns))
    return out


def edges(lib: Library, kind: str | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    df = lib.rel("edge") if kind is None else lib.rel("edge", kind=kind)
    return df.withColumnRenamed("from", src).withColumnRenamed("to", dst)


def evidence(label: str, *columns: str) -> Column:
    """A tuple of a label and columns as canonical JSON text: clauses of diagnostic differ in shape."""
    return F.concat(F.lit("["), F.concat_ws(",", text(F.lit(label)), *[text(c) for c in columns]), F.lit("]"))


def text(c: Column | str) -> Column:
    """JSON text of a column given by name, or of a literal given as Column."""
    c = F.col(c) if isinstance(c, str) else c
    j = F.to_json(F.array(c))
    return j.substr(F.lit(2), F.length(j) - 2)


NULL = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
__all__ = ["NULL", "REGISTRY", "Library", "T", "counted", "edges", "evidence", "marked", "predicate", "table", "text", "top", "union", "within", "without"]
