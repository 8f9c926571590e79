"""The engine: stored relations, a rule program, and queries over both.

    engine = Engine(spark)
    engine.register("handle", df)
    engine.load("reachable(x, y) := *edge{from: x, to: y}. ...")
    engine.query('? reachable("a", y) order by y.').show()
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import time, values
from .operators import content, graph, history, introspection, lifecycle, search
from .plans import syntax as S
from .plans.compiler import Catalog, Compiler, Primitive, RuleProblem
from .sources import config, schema

#: Bytes that one task writes, about, by the planner's estimate.
WRITE_BYTES = 256 << 20
#: Bytes that a join broadcasts at most: counted while the query runs, and as the planner estimates them. It takes a table
#: for the size of its compressed files, of which ids fill twenty times as much memory.
BROADCAST_BYTES = {"spark.sql.adaptive.autoBroadcastJoinThreshold": 1 << 20, "spark.sql.autoBroadcastJoinThreshold": 256 << 10}
CAPABILITIES = ("Read", "ReadFull", "Search", "Match", "Eval", "TrailPrivateRead", "Extract")


def primitives() -> dict[str, Primitive]:
    one, both = ((0,),), ((0,), (1,))
    p = lambda name, params, build, **k: Primitive(name, tuple(params.split()), build, **k)
    known = [
        p("upstream", "h anc", graph.upstream, needs=both, doc="nodes reached along edges"),
        p("downstream", "h desc", graph.downstream, needs=both, doc="nodes that reach h along edges"),
        p("impact", "h x depth", graph.impact, needs=both, depth=2, doc="dependents of h and their distance"),
        p("neighborhood", "h depth member", graph.neighborhood, needs=((0,), (2,)), depth=1, doc="nodes around h and their distance"),
        p("terminal", "h", lifecycle.terminal, soft=True, in_history=True, doc="handles with a terminal status"),
        p("active", "h", lifecycle.active, soft=True, in_history=True, doc="handles that are not terminal"),
        p("settled", "h", lifecycle.settled, soft=True, in_history=True, doc="handles with a settled status"),
        p("lifecycle_status_classification", "status classification origin", lifecycle.classification, doc="classes of statuses"),
        p("pipeline_position", "h n", lifecycle.pipeline_position, soft=True, in_history=True, doc="place of a handle's status in the pipeline"),
        p("pipeline_position_for", "s n", lifecycle.pipeline_position_for, soft=True, in_history=True, doc="place of a status in the pipeline"),
        p("obligation", "h", lifecycle.obligation, soft=True, in_history=True, doc="labels of linear namespaces"),
        p("discharged", "h", lifecycle.discharged, soft=True, doc="handles with an incoming Discharges edge"),
        p("undischarged", "h", lifecycle.undischarged, soft=True, doc="open obligations"),
        p("cite_count", "h n", graph.cite_count, doc="incoming Cites edges"),
        p("in_degree", "h n", graph.in_degree, doc="incoming edges"),
        p("out_degree", "h n", graph.out_degree, doc="outgoing edges"),
        p("discharge_count", "h n", graph.discharge_count, doc="incoming Discharges edges of a handle"),
        p("token_estimate", "h n", graph.token_estimate, doc="tokens of a handle's content"),
        p("freshness", "h days", lifecycle.freshness, in_history=True, doc="days since a handle's date"),
        p("flux", "h days delta", lifecycle.flux, needs=((1,),), in_history=True, doc="status changes of the last days"),
        p("git_mtime", "file instant", lifecycle.git_mtime, doc="latest change of a file"),
        p("changed_within", "h days", lifecycle.changed_within, needs=((1,),), doc="handles whose file changed in the last days"),
        p("repository_operation_capability", "operation availability provider reason", introspection.repository, doc="operations of the host's repository"),
        p("search", "query handle span_id score reason field low_confidence", search.search, needs=one, doc="ranked lexical search"),
        p("read", "handle budget span_id text start_line end_line tokens", content.read, needs=((0, 1), (0, 1, 2)), doc="spans of a handle within a token budget"),
        p("read_full", "handle content", content.read_full, needs=one, doc="the whole content of a handle"),
        p("match", "pattern handle line snippet", content.match, needs=((0, 1),), doc="lines that match a regular expression"),
        p("schema", "name kind signature determinism source_provenance", introspection.schema, doc="relations, primitives and predicates"),
        p("predicates", "name doc source_file source_lines", introspection.predicates, doc="derived predicates"),
        p("verbs", "name query doc output_schema", introspection.verbs, doc="saved verbs"),
        p("describe", "name doc", introspection.describe, doc="documentation by name"),
        p("source_of", "name file lines", introspection.source_of, doc="where a predicate is defined"),
        p("examples", "name example", introspection.examples, doc="example queries"),
        p("sources", "name recognizes capabilities doc", introspection.sources, doc="source adapters"),
    ]
    return {x.name: x for x in known}


def bound_broadcasts(spark: SparkSession) -> None:
    """Lowers the session's bounds of broadcasts to BROADCAST_BYTES; lower ones, or none at all (-1), stay. Results don't
    depend on them. As plans run later, the settings stay."""
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most in BROADCAST_BYTES.items():
        given = spark.conf.get(name, None) or spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        if not given.startswith("-") and size(given) > most:
            spark.conf.set(name, str(most))


def _bound(atom, values_: dict):
    """An atom with verb_arg("name", term) put as term = value, which keeps each argument's own type."""
    if isinstance(atom, S.Call) and atom.name == "verb_arg" and len(atom.args) == 2 and isinstance(atom.args[0], S.Lit) and atom.args[0].value in values_:
        return S.Compare("=", atom.args[1], S.Lit(values_[atom.args[0].value]))
    if isinstance(atom, (S.At, S.Aggregate)):
        return replace(atom, body=tuple(_bound(a, values_) for a in atom.body))
    return atom


class Engine:
    """Context of primitives and plans. `day` is the evaluation day, as days since 1970-01-01."""

    def __init__(self, spark: SparkSession, *, evaluation_day: int | None = None, capabilities: tuple[str, ...] = CAPABILITIES):
        self.spark, self.day = spark, time.today() if evaluation_day is None else evaluation_day
        bound_broadcasts(spark)
        self.capabilities = set(capabilities)
        self.relations: dict[str, DataFrame] = {}
        self.pending: dict[str, Callable[[], DataFrame]] = {}
        self.program = S.Program()
        self.primitives = primitives()
        self.warnings: list[str] = []
        self._histories: dict[str, Engine] = {}
        self.version = object()

    # Relations

    def register(self, name: str, df: DataFrame) -> None:
        """Adds or replaces a stored relation. Known relations get their full schema; any other table keeps its
        columns, as values of the language."""
        self.pending.pop(name, None)
        self.relations[name] = self._valued(name, df)
        self.changed()

    @staticmethod
    def _valued(name: str, df: DataFrame) -> DataFrame:
        return schema.conform(name, df) if name in schema.FIELDS else values.plain(df)

    def changed(self) -> None:
        """What was planned from relations or rules so far holds no more."""
        self.version = object()
        self._histories.clear()

    def register_lazily(self, name: str, load: Callable[[], DataFrame]) -> None:
        """Registers a table that is opened only when a plan first reads it."""
        self.relations.pop(name, None)
        self.pending[name] = load
        self.changed()

    def add(self, name: str, df: DataFrame) -> None:
        known = name in self.relations or name in self.pending
        self.register(name, self.relation(name).unionByName(schema.conform(name, df)) if known else df)

    def facts(self, name: str, records: list[dict]) -> None:
        self.register(name, schema.rows(self.spark, name, records))

    def relation(self, name: str) -> DataFrame:
        if name in self.pending:
            self.relations[name] = self._valued(name, self.pending.pop(name)())
        if name in self.relations:
            return self.relations[name]
        if name in schema.FIELDS:
            return self.spark.createDataFrame([], schema.schema(name))
        raise RuleProblem(f"unknown relation *{name}")

    def hide(self, hidden: DataFrame) -> Engine:
        """An engine without the facts of (corpus, source, native_id) in hidden, removed before any rule."""
        for name in list(self.pending):
            self.relation(name)
        out = self._copy()
        for name, df in self.relations.items():
            if name in schema.FIELDS and schema.FIELDS[name][0]:
                out.relations[name] = df.join(hidden.select("corpus", "source", "native_id").distinct(), ["corpus", "source", "native_id"], "left_anti").select(*df.columns)
        return out

    def _copy(self) -> Engine:
        out = Engine(self.spark, evaluation_day=self.day, capabilities=tuple(self.capabilities))
        out.relations, out.pending = dict(self.relations), dict(self.pending)
        out.program, out.warnings, out.primitives = self.program, self.warnings, self.primitives
        return out

    # What plans ask of their context

    def local(self, rows: list[tuple], kinds: str) -> DataFrame:
        return self.spark.createDataFrame(rows, kinds)

    def shared(self, df: DataFrame) -> DataFrame:
        """A frame that several plans read: written once, so that a lost executor costs nothing and no memory is held."""
        return self.written(df)

    def written(self, df: DataFrame) -> DataFrame:
        """df written to the cluster's shared folder and read back: short lineage, known size."""
        found = self.spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            local = self.spark.sparkContext.master.startswith("local[") or self.spark.sparkContext.master == "local"
            found = "file://" + tempfile.mkdtemp(prefix="tidemark-") if local else self.spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
            self.spark.conf.set("spark.checkpoint.dir", found)
        path = f"{found.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
        void = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)}
        whole = df.select(*[F.col(c).cast("string").alias(c) if c in void else F.col(c) for c in df.columns])
        plan = str(df._jdf.queryExecution().optimizedPlan().toString())
        # After a shuffle, several of its partitions in one writing task would each hold their sorts and maps in it.
        (whole.hint("rebalance") if any(x in plan for x in ("Join", "Aggregate", "Window", "Sort")) else whole.coalesce(self._tasks(df))).write.parquet(path)
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
        back = self.spark.read.parquet(path)
        return back.select(*[F.lit(None).alias(c) if c in void else F.col(c) for c in df.columns])

    def _tasks(self, df: DataFrame) -> int:
        """Writing tasks: few, so that tables have few files, but so many that none writes much more than WRITE_BYTES."""
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        most = max(2 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8, size // WRITE_BYTES)
        return min(most, 1 << 20)

    def ranked(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """Dense rank over all rows, highest key first, without one task for all of them: distinct keys are
        range-partitioned and numbered by partition offsets."""
        keys = self.written(df.select(key).distinct().repartitionByRange(F.col(key).desc_nulls_last()).sortWithinPartitions(F.col(key).desc_nulls_last()).withColumn("_part", F.spark_partition_id()))
        sizes = keys.groupBy("_part").agg(F.count("*").alias("_size"))
        before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(key).desc_nulls_last()))
        numbered = keys.withColumn("_in", inside).join(before, "_part").select(F.col(key).alias("_rank_key"), (F.col("_before") + F.col("_in")).cast("long").alias(out))
        return df.join(numbered, F.col(key).eqNullSafe(F.col("_rank_key"))).drop("_rank_key")

    def taken(self, df: DataFrame, order: list) -> DataFrame:
        """The rows in this order whose running sum of _cost, of 0 or more each, is within their _budget, without one
        task for all of them: range partitions start from the sum of those before them, and one that starts beyond
        every budget is left out unread."""
        rows = self.written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
        sums = rows.groupBy("_part").agg(F.sum("_cost").alias("_own"), F.max("_budget").alias("_most"))
        # One row a partition.
        earlier = F.sum("_own").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        starts = sums.select("_part", "_most", F.coalesce(earlier, F.lit(0)).alias("_start")).where("_start <= _most")
        inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        within = rows.join(F.broadcast(starts.select("_part", "_start")), "_part").withColumn("_sum", F.col("_start") + F.sum("_cost").over(inside))
        return within.where("_sum <= _budget").drop("_part", "_start", "_sum")

    def require(self, capability: str) -> None:
        if capability not in self.capabilities:
            raise PermissionError(f"this engine lacks the capability {capability}")

    def at(self, ref: str) -> Engine:
        if ref not in self._histories:
            name, day = history.resolve(self.relation("snapshot"), ref, self.day)
            handle, snapshot = history.overlay(self.relation("handle"), self.relation("snapshot"), name)
            out = self._copy()
            out.day = day
            out.relations |= {"handle": handle, "snapshot": snapshot}
            self._histories[ref] = out
            self.warnings.append(f"partial_history: {ref} patches current handles with snapshot {name}")
        return self._histories[ref]

    # Programs and queries

    def load(self, text: str, source: str = "inline", layer: str = "project") -> None:
        """Adds a program. A name defined here replaces the name's clauses of other layers; primitives can be
        redefined only if they are soft, protected predicates not at all."""
        self.merge(S.parse(text, source), layer)

    def merge(self, program: S.Program, layer: str = "project") -> None:
        names = {r.name for r in program.rules}
        for n in names:
            p = self.primitives.get(n)
            if p and not p.soft:
                raise RuleProblem(f"{n} is a primitive that rules can't define")
        shadow = {a.args["name"] for a in self.program.annotations if a.kind == "predicate" and a.args.get("shadow") == "forbid"}
        for n in sorted(names & shadow):
            if any(r.name == n and r.layer != layer for r in self.program.rules):
                raise RuleProblem(f"{n} is protected: it can't be redefined")
        replaced = {r.name for r in self.program.rules if r.name in names and r.layer != layer}
        for n in sorted(replaced):
            self.warnings.append(f"{n} is redefined by {layer}")
        merged = S.Program(rules=[r for r in self.program.rules if r.name not in replaced], annotations=list(self.program.annotations), blocks=list(self.program.blocks), optional=list(self.program.optional))
        merged.rules += [replace(r, layer=layer) for r in program.rules]
        merged.annotations += program.annotations
        merged.blocks += program.blocks
        merged.optional += program.optional
        self.program = merged
        rows = config.rows(program.blocks)
        if rows:
            self.add("config", schema.rows(self.spark, "config", rows))
        self.changed()

    def define(self, name: str, params: tuple[str, ...], build) -> None:
        """A predicate planned by a function of the engine that returns a DataFrame with params as columns."""
        wrapped = lambda ctx: build(ctx).select(*[F.col(c).alias(f"p{i}") for i, c in enumerate(params)])
        self.primitives = self.primitives | {name: Primitive(name, params, wrapped, soft=True)}

    def compiler(self) -> Compiler:
        return Compiler(self, Catalog.of(self.program))

    def query(self, text: str, limit: int | None = None) -> DataFrame:
        """The rows of one query; rules before it are local to this call."""
        found = self.queries(text)
        if len(found) != 1:
            raise RuleProblem(f"the text has {len(found)} queries, not one")
        return found[0] if limit is None else found[0].limit(limit)

    def queries(self, text: str) -> list[DataFrame]:
        self.require("Eval")
        program = S.parse(text)
        engine = self
        if program.rules or program.blocks or program.annotations:
            engine = self._copy()
            engine.merge(program, "query")
        compiler = engine.compiler()
        return [compiler.query(q) for q in program.queries]

    def verb(self, name: str, /, **args) -> DataFrame:
        """A saved query, its arguments bound as verb_arg(name, value) facts."""
        found = next((a.args for a in reversed(self.program.annotations) if a.kind == "verb" and a.args["name"] == name), None)
        if found is None:
            raise LookupError(f"no verb {name}")
        values_ = {}
        for part in filter(None, (x.strip() for x in str(found.get("args", "")).split(","))):
            key, _, rest = part.partition(":")
            kind, _, default = rest.partition("=")
            if key.strip() in args:
                values_[key.strip()] = args.pop(key.strip())
            elif default.strip():
                values_[key.strip()] = {"Int": int, "Number": float, "Bool": lambda v: v == "true"}.get(kind.strip(), lambda v: v.strip('"'))(default.strip())
            else:
                raise TypeError(f"verb {name} needs {key.strip()}")
        if args:
            raise TypeError(f"verb {name} has no argument {', '.join(sorted(args))}")
        program = S.parse(str(found["query"]), f"verb {name}")
        bind = lambda atoms: tuple(_bound(a, values_) for a in atoms)
        program.rules = [replace(r, body=bind(r.body)) for r in program.rules]
        program.queries = [replace(q, body=bind(q.body), rules=tuple(replace(r, body=bind(r.body)) for r in q.rules)) for q in program.queries]
        program.rules += [S.Rule("verb_arg", (S.Lit(k), S.Lit(v)), (), f"verb {name}") for k, v in values_.items()]
        engine = self._copy()
        engine.merge(program, "query")
        return engine.compiler().query(program.queries[0])
