"""Graph primitives: reachability, impact, neighbourhoods and degrees.

Traversals start from the bound endpoint only, and one path serves every size. First a few hops are walked in one
job, each from the nodes that the last one reached; most graphs end there. A deeper graph gets shortcuts: level k
holds walks of exactly 2^k edges, made by joining level k - 1 with itself, for nodes with few such ends (`SPREAD`),
so a level has at most SPREAD rows a node. A sweep then relaxes distances over all levels, longest walks first. The
shortest path to a node is a sum of powers of two, so a chain of any length takes one sweep; sweeps go on until one
changes nothing, and as each ends with plain edges, distances are then exact whatever shortcuts exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lifecycle

#: Hops of the first job.
HOPS = 4
#: Ends a node may have on one level of shortcuts.
SPREAD = 8
#: Edge kinds that impact follows where none are configured.
IMPACT_KINDS = ("DependsOn", "Supersedes", "Verifies")


def _nearest(found: DataFrame) -> DataFrame:
    return found.groupBy("root", "node").agg(F.min("depth").alias("depth"))


def _hop(state: DataFrame, edges: DataFrame, length: int, most: int | None) -> DataFrame:
    """What one step of this length reaches from state, with the new depth."""
    out = state.select("root", F.col("node").alias("src"), "depth").join(edges, "src").select("root", F.col("dst").alias("node"), (F.col("depth") + length).alias("depth"))
    return out if most is None else out.where(F.col("depth") <= most)


def _shortcuts(ctx, edges: DataFrame, most: int | None) -> list[DataFrame]:
    """Levels 1, 2, ...: src and the ends of its walks of 2, 4, ... edges. Walks end at nodes with edges of their
    own; steps to other nodes are the plain edges' affair."""
    few = lambda pairs: ctx.written(pairs.where("src <> dst").groupBy("src").agg(F.collect_set("dst").alias("ends")).where(F.size("ends") <= SPREAD))
    sources = edges.groupBy("src").agg(F.count("*").alias("n"))
    inner = edges.join(sources.select(F.col("src").alias("dst")), "dst", "left_semi")
    nodes = inner.select("src").distinct().count()
    # Nodes of very many edges are left out before their ends are gathered.
    level, levels = few(inner.join(inner.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") <= SPREAD), "src", "left_semi")), []
    length = 2
    while length <= nodes and (most is None or length <= most):
        pairs = level.select("src", F.explode("ends").alias("dst"))
        twice = pairs.select("src", F.col("dst").alias("via")).join(level.withColumnRenamed("src", "via"), "via")
        level = few(twice.select("src", F.explode("ends").alias("dst")))
        if level.isEmpty():
            break
        levels.append(level)
        length *= 2
    return levels


def _leap(state: DataFrame, level: DataFrame, length: int, most: int | None) -> DataFrame:
    """state and what one leap from it reaches; state is read once, so that leaps can be chained in one plan."""
    own = F.array(F.struct("node", "depth"))
    ends = F.transform(F.coalesce("ends", F.array().cast("array<string>")), lambda x: F.struct(x.alias("node"), (F.col("depth") + length).alias("depth")))
    both = state.join(level.withColumnRenamed("src", "node"), "node", "left").select("root", F.explode(F.concat(own, ends)).alias("e")).select("root", "e.node", "e.depth")
    return _nearest(both if most is None else both.where(F.col("depth") <= most))


def reach(ctx, seeds: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(root, node, depth) of the nodes other than root within reach (of at most `most` hops), depth the least
    number of hops. seeds: column root; edges: src, dst."""
    edges = ctx.written(edges.where("src is not null and dst is not null and src <> dst").distinct())
    state = seeds.where("root is not null").distinct().select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("depth"))
    first = HOPS if most is None else min(most, HOPS)
    # Each hop starts from what the last one found. A node found again is dropped at the end of the job.
    parts, front = [state], state
    for _ in range(first):
        front = _hop(front, edges, 1, most).distinct()
        parts.append(front)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    state = ctx.written(_nearest(found))
    if most is not None and most <= first or state.where(F.col("depth") == first).isEmpty():
        return state.where("depth > 0")
    levels = _shortcuts(ctx, edges, most)
    last = None
    while True:
        for i in reversed(range(len(levels))):
            state = _leap(state, levels[i], 2 << i, most)
        state = ctx.written(state) if levels else state
        state = ctx.written(_nearest(state.union(_hop(state, edges, 1, most))))
        # Depths only fall and nodes are only added, so equal counts and sums mean equal states.
        now = state.agg(F.count("*"), F.sum("depth")).first()
        if now == last:
            return state.where("depth > 0")
        last = now


def edges_of(ctx) -> DataFrame:
    return ctx.relation("edge").select(F.col("from").alias("src"), F.col("to").alias("dst"), "kind")


def nodes(ctx) -> DataFrame:
    e = edges_of(ctx)
    return ctx.relation("handle").select("id").union(e.select("src")).union(e.select("dst")).where("id is not null").distinct()


def _flip(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _side(seeds: DataFrame) -> tuple[bool, DataFrame]:
    first = "p0" in seeds.columns
    return first, seeds.select(F.col("p0" if first else seeds.columns[-1]).alias("root"))


def upstream(ctx, seeds: DataFrame) -> DataFrame:
    """Ancestors along edges as they point."""
    first, roots = _side(seeds)
    e = edges_of(ctx).select("src", "dst")
    found = reach(ctx, roots, e if first else _flip(e))
    return found.select(F.col("root" if first else "node").alias("p0"), F.col("node" if first else "root").alias("p1"))


def downstream(ctx, seeds: DataFrame) -> DataFrame:
    first, roots = _side(seeds)
    e = edges_of(ctx).select("src", "dst")
    found = reach(ctx, roots, _flip(e) if first else e)
    return found.select(F.col("root" if first else "node").alias("p0"), F.col("node" if first else "root").alias("p1"))


def impact(ctx, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """What depends on h, by hops over edges of the configured kinds; most: a bound of the depths wanted."""
    first, roots = _side(seeds)
    own = lifecycle.values(ctx, "impact.traverse")
    e = edges_of(ctx).where(F.col("kind").isin(*(own or IMPACT_KINDS))).select("src", "dst")
    found = reach(ctx, roots, _flip(e) if first else e, most)
    return found.select(F.col("root" if first else "node").alias("p0"), F.col("node" if first else "root").alias("p1"), F.col("depth").alias("p2"))


def neighborhood(ctx, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """Nodes around h without regard to direction; h itself at depth 0 if it is a node."""
    first, roots = _side(seeds)
    e = edges_of(ctx).select("src", "dst")
    found = reach(ctx, roots, e.union(_flip(e)), most)
    own = roots.distinct().join(nodes(ctx).withColumnRenamed("id", "root"), "root", "left_semi").select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("depth"))
    found = found.union(own)
    return found.select(F.col("root" if first else "node").alias("p0"), F.col("depth").alias("p1"), F.col("node" if first else "root").alias("p2"))


def _counted(universe: DataFrame, ends: DataFrame) -> DataFrame:
    n = ends.groupBy("id").agg(F.count("*").alias("n"))
    return universe.join(n, "id", "left").select(F.col("id").alias("p0"), F.coalesce("n", F.lit(0)).cast("long").alias("p1"))


def in_degree(ctx) -> DataFrame:
    return _counted(nodes(ctx), edges_of(ctx).select(F.col("dst").alias("id")))


def out_degree(ctx) -> DataFrame:
    return _counted(nodes(ctx), edges_of(ctx).select(F.col("src").alias("id")))


def cite_count(ctx) -> DataFrame:
    return _counted(nodes(ctx), edges_of(ctx).where("kind = 'Cites'").select(F.col("dst").alias("id")))


def discharge_count(ctx) -> DataFrame:
    return _counted(ctx.relation("handle").select("id").distinct(), edges_of(ctx).where("kind = 'Discharges'").select(F.col("dst").alias("id")))


def token_estimate(ctx) -> DataFrame:
    n = ctx.relation("content").groupBy(F.col("handle").alias("id")).agg(F.sum("tokens").alias("n"))
    ids = ctx.relation("handle").select("id").distinct()
    return ids.join(n, "id", "left").select(F.col("id").alias("p0"), F.coalesce("n", F.lit(0)).cast("long").alias("p1"))
