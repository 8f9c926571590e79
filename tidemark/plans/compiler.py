"""From rules to DataFrames.

A predicate becomes one DataFrame with columns p0, p1, ...; a body becomes a frame, a DataFrame with one column
a variable. Atoms are taken in text order, each as soon as what it needs is bound; the order of joins, their
strategy, pushdown and pruning are left to Catalyst. Aggregates are decorrelated: their bodies run once over the
distinct outer keys and are grouped by them. Only predicates that a query reaches are built.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from . import syntax as S


#: Tables that the rows of a recursive predicate may lie in.
PARTS = 6


class RuleProblem(ValueError):
    """A program that can't be planned."""


@dataclass
class Frame:
    df: DataFrame | None  # None: no atom yet, one row without columns
    names: tuple[str, ...] = ()

    def type(self, name: str) -> T.DataType:
        return self.df.schema[f"v_{name}"].dataType

    def rows(self, spark) -> DataFrame:
        return spark.range(1).select() if self.df is None else self.df


@dataclass
class Primitive:
    """Rows the engine computes itself. build(context, seeds) returns columns p0, ...; seeds has the distinct
    values of the bound positions as columns p<i>, or is None where none is needed."""

    name: str
    params: tuple[str, ...]
    build: object
    needs: tuple[tuple[int, ...], ...] = ()  # alternatives: positions of which all must be bound
    soft: bool = False  # rules may define it
    in_history: bool = False  # allowed in time blocks
    doc: str = ""
    depth: int | None = None  # the position of a traversal's depth: build takes an upper bound of it as `most`


# Dependencies and strata -----------------------------------------------------------------------------------


def calls(atoms: Iterable, strict: bool = False) -> Iterable[tuple[str, bool]]:
    """(predicate, whether below a negation or aggregate) of all calls in a body."""
    for a in atoms:
        if isinstance(a, S.Call):
            yield a.name, strict
        elif isinstance(a, S.Not) and isinstance(a.atom, S.Call):
            yield a.atom.name, True
        elif isinstance(a, S.At):
            yield from calls(a.body, strict)
        elif isinstance(a, S.Aggregate):
            yield from calls(a.body, True)


def components(graph: dict[str, set[str]]) -> list[list[str]]:
    """Strongly connected components, each after those it depends on (an iterative depth-first search)."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    out: list[list[str]] = []
    for root in sorted(graph):
        if root in index:
            continue
        work = [(root, iter(sorted(graph[root])))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, todo = work[-1]
            for n in todo:
                if n not in graph:
                    continue
                if n not in index:
                    index[n] = low[n] = len(index)
                    stack.append(n)
                    on.add(n)
                    work.append((n, iter(sorted(graph[n]))))
                    break
                if n in on:
                    low[node] = min(low[node], index[n])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    found = []
                    while True:
                        n = stack.pop()
                        on.discard(n)
                        found.append(n)
                        if n == node:
                            break
                    out.append(sorted(found))
    return out


@dataclass
class Catalog:
    """Rules by predicate with their signatures, checked."""

    rules: dict[str, list[S.Rule]]
    params: dict[str, tuple[str, ...]] = field(default_factory=dict)
    optional: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, program: S.Program, known: Iterable[str] = ()) -> Catalog:
        rules: dict[str, list[S.Rule]] = {}
        for r in program.rules:
            rules.setdefault(r.name, []).append(r)
        declared = {a.args["name"]: a for a in program.annotations if a.kind == "predicate"}
        out = cls(rules, optional={r.name for r in program.optional} - set(rules))
        for name, clauses in rules.items():
            widths = {len(r.head) for r in clauses}
            if len(widths) > 1:
                raise RuleProblem(f"{name} has clauses of {' and '.join(map(str, sorted(widths)))} terms")
            width = widths.pop()
            names = [p.strip() for p in str(declared[name].args.get("args", "")).split(",") if p.strip()] if name in declared else []
            if len(names) != width:
                names = [next((r.head[i].name for r in clauses if isinstance(r.head[i], S.Var)), f"p{i}") for i in range(width)]
            if len(set(names)) < width:
                names = [n if names.index(n) == i else f"{n}_{i}" for i, n in enumerate(names)]
            out.params[name] = tuple(names)
        for r in program.optional:
            out.params.setdefault(r.name, tuple(t.name if isinstance(t, S.Var) else f"p{i}" for i, t in enumerate(r.head)))
        return out

    def demanded(self, roots: Iterable[str]) -> set[str]:
        out, todo = set(), [r for r in roots if r in self.rules]
        while todo:
            name = todo.pop()
            if name not in out:
                out.add(name)
                todo += [c for r in self.rules[name] for c, _ in calls(r.body) if c in self.rules]
        return out

    def stages(self, names: set[str]) -> list[tuple[list[str], bool]]:
        """(predicates, whether recursive) in an order that has what each needs before it."""
        graph = {n: {c for r in self.rules[n] for c, _ in calls(r.body) if c in names} for n in names}
        out = []
        for group in components(graph):
            inside = set(group)
            for n in group:
                for r in self.rules[n]:
                    for c, strict in calls(r.body):
                        if strict and c in inside:
                            raise RuleProblem(f"{n} depends on {c} through a negation or an aggregate in a cycle")
            recursive = len(group) > 1 or group[0] in graph[group[0]]
            if recursive:
                for n in group:
                    for r in self.rules[n]:
                        if any(c in inside for c, _ in calls(r.body)) and any(isinstance(t, (S.Bin, S.Tup)) for t in r.head):
                            raise RuleProblem(f"a recursive clause of {n} computes a value in its head")
            out.append((group, recursive))
        return out


# Bodies ----------------------------------------------------------------------------------------------------


def direct(terms: Iterable) -> set[str]:
    """Variables that an atom with these terms binds."""
    out = set()
    for t in terms:
        if isinstance(t, S.Var):
            out.add(t.name)
        elif isinstance(t, S.Tup):
            out |= direct(t.items)
    return out


def terms_of(atom) -> tuple:
    if isinstance(atom, S.Stored):
        return tuple(t for _, t in atom.fields)
    return (*atom.args, *(t for _, t in atom.named))


def binds(atom) -> set[str]:
    if isinstance(atom, (S.Stored, S.Call)):
        return direct(terms_of(atom))
    if isinstance(atom, S.Compare) and atom.op == "=":
        return direct([atom.left]) | direct([atom.right])
    if isinstance(atom, S.Aggregate):
        return direct([atom.result])
    if isinstance(atom, S.At):
        return set().union(*map(binds, atom.body))
    return set()


class Compiler:
    """Plans bodies and predicates for one context (an engine's relations, or a snapshot laid over them)."""

    def __init__(self, context, catalog: Catalog, outer: Compiler | None = None):
        self.context, self.catalog, self.outer = context, catalog, outer
        self.spark = context.spark
        self.built: dict[str, DataFrame] = {}
        self.deltas: dict[str, DataFrame] = {}

    # Predicates

    def prepare(self, roots: Iterable[str]) -> None:
        """Builds what the roots reach and is not built yet."""
        names = {n for n in self.catalog.demanded(roots) if n not in self.built}
        uses: dict[str, int] = {}
        for n in names:
            for r in self.catalog.rules[n]:
                for c, _ in calls(r.body):
                    uses[c] = uses.get(c, 0) + 1
        for r in roots:
            uses[r] = uses.get(r, 0) + 1
        for group, recursive in self.catalog.stages(names):
            if recursive:
                self.fixpoint(group)
            else:
                df = V.union([self.clause(r) for r in self.catalog.rules[group[0]]]) if any(r.body for r in self.catalog.rules[group[0]]) else self.facts(self.catalog.rules[group[0]])
                df = df.distinct()
                if uses.get(group[0], 0) > 1 and any(r.body for r in self.catalog.rules[group[0]]):
                    df = self.context.shared(df)
                self.built[group[0]] = df

    def facts(self, rules: list[S.Rule]) -> DataFrame:
        """Ground rows as one local relation."""
        if any(not isinstance(t, S.Lit) or isinstance(t.value, tuple) for r in rules for t in r.head) or not rules[0].head:
            return V.union([self.clause(r) for r in rules])
        kinds = []
        for i in range(len(rules[0].head)):
            seen = {type(r.head[i].value) for r in rules} - {type(None)}
            if len(seen) > 1:
                return V.union([self.clause(r) for r in rules])
            kinds.append({str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType()}[seen.pop()] if seen else T.NullType())
        schema = T.StructType([T.StructField(f"p{i}", t) for i, t in enumerate(kinds)])
        return self.spark.createDataFrame([tuple(t.value for t in r.head) for r in rules], schema)

    def clause(self, rule: S.Rule, delta: int | None = None) -> DataFrame:
        """The rows of one clause; delta: the position of the call that reads the newest rows only."""
        frame = self.body(rule.body, delta=delta)
        rows = frame.rows(self.spark)
        out = []
        for i, t in enumerate(rule.head):
            if isinstance(t, S.Wild):
                out.append(F.lit(None).alias(f"p{i}"))
            else:
                missing = S.variables(t) - set(frame.names)
                if missing:
                    raise RuleProblem(f"{rule.name}: {', '.join(sorted(missing))} in the head is not bound by the body")
                out.append(self.term(t, frame)[0].alias(f"p{i}"))
        return rows.select(*out) if out else rows.select(F.lit(True).alias("p"))

    def doubled(self, name: str) -> list[S.Rule]:
        """The clauses of a predicate; those of a transitive closure (base rows, extended by one base row at an end)
        extended by the closure itself, so that rounds grow with the logarithm of the depth."""
        clauses = self.catalog.rules[name]
        if len(clauses) != 2 or any(len(r.head) != 2 or not all(isinstance(t, S.Var) for t in r.head) for r in clauses):
            return clauses
        base, more = sorted(clauses, key=lambda r: len(r.body))
        if len(base.body) != 1 or len(more.body) != 2 or any(isinstance(a, S.Call) and a.name == name for a in base.body):
            return clauses
        own = [a for a in more.body if isinstance(a, S.Call) and a.name == name]
        if len(own) != 1 or len(own[0].args) != 2 or own[0].named or not all(isinstance(t, S.Var) for t in own[0].args):
            return clauses
        other = next(a for a in more.body if a is not own[0])
        (x, z), (p, q) = [t.name for t in more.head], [t.name for t in own[0].args]
        ends = (q, z) if p == x and q != z else (x, p) if q == z and p != x else None
        first = tuple(t.name for t in base.head)
        if ends is None or len({x, z, *ends}) != 3 or (S.variables(base.body[0]) - set(first)) & {x, z, *ends}:
            return clauses
        if len(set(first)) != 2 or S.revariabled(base.body[0], dict(zip(first, ends, strict=True))) != other:
            return clauses
        step = S.Call(name, tuple(S.Var(v) for v in ends))
        return [base, replace(more, body=tuple(a if a is own[0] else step for a in more.body))]

    def fixpoint(self, group: list[str]) -> None:
        """Semi-naive evaluation: each round joins only the newest rows of one recursive call with all rows of
        the others, and keeps what is new. Every round is written, so lineage stays short; rows found so far are
        rewritten as one table whenever they lie in PARTS tables, so a round reads few of them."""
        inside = set(group)
        start: dict[str, DataFrame] = {}
        steps: list[tuple[S.Rule, int]] = []
        for n in group:
            clauses = self.doubled(n) if len(group) == 1 else self.catalog.rules[n]
            first = [r for r in clauses if not any(c in inside for c, _ in calls(r.body))]
            if not first:
                raise RuleProblem(f"{n} has no clause that doesn't depend on itself")
            start[n] = V.union([self.clause(r) for r in first]).distinct()
            for r in clauses:
                steps += [(r, i) for i, a in enumerate(r.body) if isinstance(a, S.Call) and a.name in inside]
        known = {n: self.context.written(df) for n, df in start.items()}
        parts = dict.fromkeys(group, 1)
        newest = {n: df for n, df in known.items() if not df.isEmpty()}
        while newest:
            self.built |= known
            self.deltas = newest
            found: dict[str, list[DataFrame]] = {}
            for r, i in steps:
                if r.body[i].name in newest:
                    found.setdefault(r.name, []).append(self.clause(r, i))
            self.deltas = {}
            fresh = {}
            for n, rows in found.items():
                rows = V.union([known[n].limit(0), *rows]).distinct()
                same = None
                other = known[n].select(*[F.col(c).alias(f"k_{c}") for c in known[n].columns])
                for c in rows.columns:
                    one = F.col(c).eqNullSafe(F.col(f"k_{c}"))
                    same = one if same is None else same & one
                fresh[n] = self.context.written(rows.join(other, same, "left_anti"))
            newest = {n: df for n, df in fresh.items() if not df.isEmpty()}
            for n, df in newest.items():
                known[n], parts[n] = known[n].union(df), parts[n] + 1
                if parts[n] >= PARTS:
                    known[n], parts[n] = self.context.written(known[n]), 1
        self.built |= known

    def predicate(self, name: str) -> DataFrame:
        if name in self.built:
            return self.built[name]
        if self.outer and name not in self.catalog.rules:
            return self.outer.predicate(name)
        if name in self.catalog.rules:
            self.prepare([name])
            return self.built[name]
        raise RuleProblem(f"unknown predicate {name}")

    # Terms

    def term(self, t, frame: Frame) -> tuple[Column, T.DataType]:
        if isinstance(t, S.Lit):
            return V.literal(t.value)
        if isinstance(t, S.Var):
            if t.name not in frame.names:
                raise RuleProblem(f"{t.name} is not bound")
            return F.col(f"v_{t.name}"), frame.type(t.name)
        if isinstance(t, S.Bin):
            return V.arithmetic(t.op, *self.term(t.left, frame), *self.term(t.right, frame))
        if isinstance(t, S.Tup):
            parts = [self.term(x, frame) for x in t.items]
            return F.struct(*[c.alias(f"_{i + 1}") for i, (c, _) in enumerate(parts)]), T.StructType([T.StructField(f"_{i + 1}", k) for i, (_, k) in enumerate(parts)])
        if isinstance(t, S.Func):
            raise RuleProblem(f"functions such as {t.name}() can't be planned")
        raise RuleProblem("a wildcard has no value")

    def match(self, df: DataFrame, column: Column, kind: T.DataType, t, names: dict[str, T.DataType]) -> DataFrame:
        """df with term t unified with a column: binds new variables (recorded in names), filters the rest."""
        if isinstance(t, S.Wild):
            return df
        if isinstance(t, S.Var) and t.name not in names:
            names[t.name] = kind
            return df.withColumn(f"v_{t.name}", column)
        if isinstance(t, S.Tup):
            if isinstance(kind, T.StructType) and len(kind.fields) == len(t.items):
                for f, item in zip(kind.fields, t.items, strict=True):
                    df = self.match(df, column[f.name], f.dataType, item, names)
                return df
            if isinstance(kind, T.ArrayType):
                df = df.where(F.size(column) == len(t.items))
                for i, item in enumerate(t.items):
                    df = self.match(df, column[i], kind.elementType, item, names)
                return df
            for name in direct([t]) - set(names):
                names[name] = T.StringType()
                df = df.withColumn(f"v_{name}", F.lit(None).cast("string"))
            return df.where(F.lit(False))
        own = Frame(df, tuple(names))
        return df.where(V.equal(column, kind, *self.term(t, own)))

    # Bodies

    def body(self, atoms: tuple, frame: Frame | None = None, delta: int | None = None) -> Frame:
        frame = frame or Frame(None)
        todo = list(enumerate(atoms))
        while todo:
            for at, (i, atom) in enumerate(todo):
                rest = [a for j, a in todo if j != i]
                if self.ready(atom, set(frame.names), rest):
                    frame = self.step(atom, frame, rest, delta == i)
                    del todo[at]
                    break
            else:
                self.stuck([a for _, a in todo], set(frame.names))
        return frame

    def stuck(self, atoms: list, bound: set[str]) -> None:
        for a in atoms:
            if isinstance(a, S.Not):
                raise RuleProblem(f"a negated atom has variables that nothing binds: {', '.join(sorted(S.variables(a) - bound))}")
            if isinstance(a, S.Call) and a.name in self.context.primitives:
                p = self.context.primitives[a.name]
                wanted = " or ".join(" and ".join(p.params[i] for i in alt) for alt in p.needs)
                raise RuleProblem(f"{a.name} needs {wanted or 'its arguments'} bound")
        raise RuleProblem(f"nothing binds {', '.join(sorted(set().union(*map(S.variables, atoms)) - bound))}")

    def ready(self, atom, bound: set[str], rest: list) -> bool:
        if isinstance(atom, S.Stored):
            computed = [t for t in terms_of(atom) if isinstance(t, S.Bin)]
            return set().union(*map(S.variables, computed)) <= bound | binds(atom)
        if isinstance(atom, S.Call):
            computed = [t for t in terms_of(atom) if isinstance(t, S.Bin)]
            if not set().union(*map(S.variables, computed)) <= bound | binds(atom):
                return False
            p = self.as_primitive(atom.name)
            if p and p.needs:
                args = self.positions(atom, p.params)
                given = {i for i, t in args.items() if not isinstance(t, S.Wild) and S.variables(t) <= bound}
                return any(set(alt) <= given for alt in p.needs)
            return True
        if isinstance(atom, S.Compare):
            left, right = S.variables(atom.left) <= bound, S.variables(atom.right) <= bound
            if left and right:
                return True
            if atom.op != "=":
                return False
            return left and isinstance(atom.right, (S.Var, S.Tup)) or right and isinstance(atom.left, (S.Var, S.Tup))
        if isinstance(atom, S.Not):
            return S.variables(atom) <= bound
        if isinstance(atom, S.Aggregate):
            return self.keys(atom, bound | set().union(*map(binds, rest))) <= bound
        return True

    @staticmethod
    def keys(atom: S.Aggregate, outside: set[str]) -> set[str]:
        """Variables of the braces that are bound outside."""
        inner = set().union(S.variables(atom.value), *(S.variables(t) for k, t in atom.args if k != "rank"), *map(S.variables, atom.body))
        ranked = set().union(*(S.variables(t) for k, t in atom.args if k == "rank"))
        return (inner - ranked) & outside

    def step(self, atom, frame: Frame, rest: list, newest: bool) -> Frame:
        if isinstance(atom, S.Stored):
            df = self.context.relation(atom.relation)
            columns = []
            for name, t in atom.fields:
                if name not in df.columns:
                    raise RuleProblem(f"*{atom.relation} has no field {name}")
                columns.append((F.col(f"`{name}`"), df.schema[name].dataType, t))
            return self.scan(df, columns, frame)
        if isinstance(atom, S.Call):
            return self.call(atom, frame, newest, rest)
        if isinstance(atom, S.Compare):
            return self.comparison(atom, frame)
        if isinstance(atom, S.Not):
            return self.negation(atom, frame)
        if isinstance(atom, S.At):
            self.check_history(atom.body)
            inner = Compiler(self.context.at(atom.ref), Catalog({}), self)
            return self.join(frame, inner.body(atom.body))
        return self.aggregate(atom, frame, rest)

    def as_primitive(self, name: str) -> Primitive | None:
        if name in self.catalog.rules or self.outer and name in self.outer.catalog.rules:
            return None
        return self.context.primitives.get(name)

    def positions(self, atom: S.Call, params: tuple[str, ...]) -> dict[int, object]:
        """Terms by position, named ones put in their places."""
        out = dict(enumerate(atom.args))
        for name, t in atom.named:
            if name not in params:
                raise RuleProblem(f"{atom.name} has no parameter {name}")
            if params.index(name) in out:
                raise RuleProblem(f"{atom.name}: {name} is given twice")
            out[params.index(name)] = t
        if not atom.pattern and len(out) != len(params) or any(i >= len(params) for i in out):
            raise RuleProblem(f"{atom.name} has {len(params)} parameters ({', '.join(params)}), {len(out)} are given")
        return out

    @staticmethod
    def bound(t, rest: list) -> int | None:
        """The least upper bound that the other atoms of the body, or the term itself, put on an integer term."""
        whole = lambda x: isinstance(x, S.Lit) and type(x.value) is int
        if whole(t):
            return max(t.value, 0)
        found = []
        for a in rest:
            if isinstance(a, S.Compare) and isinstance(t, S.Var):
                for left, op, right in ((a.left, a.op, a.right), (a.right, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(a.op, a.op), a.left)):
                    if left == t and whole(right) and op in ("<", "<=", "="):
                        found.append(max(right.value - (op == "<"), 0))
        return min(found, default=None)

    def call(self, atom: S.Call, frame: Frame, newest: bool, rest: Iterable = ()) -> Frame:
        p = self.as_primitive(atom.name)
        if p:
            args = self.positions(atom, p.params)
            seeds, wanted = None, sorted({i for alt in p.needs for i in alt})
            if p.needs:
                bound = [i for i in wanted if i in args and not isinstance(args[i], S.Wild) and S.variables(args[i]) <= set(frame.names)]
                seeds = frame.rows(self.spark).select(*[self.term(args[i], frame)[0].alias(f"p{i}") for i in bound]).distinct()
            most = self.bound(args.get(p.depth), rest) if p.depth is not None else None
            df = p.build(self.context, seeds, **({} if most is None else {"most": most})) if p.needs else p.build(self.context)
        else:
            if atom.name in self.catalog.optional and atom.name not in self.catalog.rules:
                args = self.positions(atom, self.catalog.params[atom.name])
                df = self.spark.range(0).select(*[F.lit(None).cast("string").alias(f"p{i}") for i in range(len(self.catalog.params[atom.name]))])
            else:
                owner = self
                while owner.outer and atom.name not in owner.catalog.rules:
                    owner = owner.outer
                if atom.name not in owner.catalog.rules:
                    raise RuleProblem(f"unknown predicate {atom.name}")
                args = self.positions(atom, owner.catalog.params[atom.name])
                df = self.deltas[atom.name] if newest else self.predicate(atom.name)
        return self.scan(df, [(F.col(f"p{i}"), df.schema[f"p{i}"].dataType, t) for i, t in sorted(args.items())], frame)

    def scan(self, df: DataFrame, columns: list, frame: Frame) -> Frame:
        names: dict[str, T.DataType] = {}
        late = []
        for c, k, t in columns:
            if isinstance(t, S.Lit):
                df = df.where(V.equal(c, k, *V.literal(t.value)))
        for c, k, t in columns:
            if isinstance(t, S.Bin):
                late.append((c, k, t))
            elif not isinstance(t, S.Lit):
                df = self.match(df, c, k, t, names)
        out = [F.col(f"v_{n}") for n in names] + [c.alias(f"_late{i}") for i, (c, _, _) in enumerate(late)]
        found = Frame(df.select(*out), tuple(names))
        kinds = [k for _, k, _ in late]
        joined = self.join(frame, found)
        for i, (_, _, t) in enumerate(late):
            joined = Frame(joined.df.where(V.equal(F.col(f"_late{i}"), kinds[i], *self.term(t, joined))).drop(f"_late{i}"), joined.names)
        return joined

    def join(self, left: Frame, right: Frame) -> Frame:
        if left.df is None:
            return right
        if right.df is None:
            return left
        names = left.names + tuple(n for n in right.names if n not in left.names)
        shared = [n for n in right.names if n in left.names]
        other = right.df.select(*[F.col(f"v_{n}").alias(f"r_{n}") if n in shared else F.col(f"v_{n}") for n in right.names], *[c for c in right.df.columns if c.startswith("_late")])
        if not shared:
            return Frame(left.df.crossJoin(other), names)
        on = None
        for n in shared:
            one = V.equal(F.col(f"v_{n}"), left.type(n), F.col(f"r_{n}"), right.type(n))
            on = one if on is None else on & one
        return Frame(left.df.join(other, on).drop(*[f"r_{n}" for n in shared]), names)

    def comparison(self, atom: S.Compare, frame: Frame) -> Frame:
        bound = set(frame.names)
        left, right = S.variables(atom.left) <= bound, S.variables(atom.right) <= bound
        rows = frame.df if frame.df is not None else self.spark.range(1).select(F.lit(True).alias("_one"))
        if left and right:
            if isinstance(atom.left, S.Wild) or isinstance(atom.right, S.Wild):
                raise RuleProblem("a wildcard has no value")
            c = V.compare(atom.op, *self.term(atom.left, frame), *self.term(atom.right, frame))
            return Frame(rows.where(c), frame.names)
        value, pattern = (atom.left, atom.right) if left else (atom.right, atom.left)
        names = {n: frame.type(n) for n in frame.names}
        column, kind = self.term(value, frame)
        df = self.match(rows.withColumn("_value", column), F.col("_value"), kind, pattern, names)
        return Frame(df.select(*[F.col(f"v_{n}") for n in names]), tuple(names))

    def negation(self, atom: S.Not, frame: Frame) -> Frame:
        named = sorted(S.variables(atom.atom) & set(frame.names))
        if isinstance(atom.atom, S.Call) and (p := self.as_primitive(atom.atom.name)) and p.needs:
            seeds = Frame(frame.rows(self.spark).select(*[f"v_{n}" for n in named]).distinct(), tuple(named))
            inner = self.call(atom.atom, seeds, False)
        else:
            inner = self.step(atom.atom, Frame(None), [], False)
        rows = frame.rows(self.spark)
        if not named:
            return Frame(rows.join(inner.df.limit(1).select(F.lit(True).alias("_found")), F.lit(True), "left_anti"), frame.names)
        other = inner.df.select(*[F.col(f"v_{n}").alias(f"r_{n}") for n in named])
        on = None
        for n in named:
            one = V.equal(F.col(f"v_{n}"), frame.type(n), F.col(f"r_{n}"), inner.type(n))
            on = one if on is None else on & one
        return Frame(rows.join(other, on, "left_anti"), frame.names)

    def check_history(self, atoms: tuple) -> None:
        for a in atoms:
            inner = a.atom if isinstance(a, S.Not) else a
            if isinstance(inner, S.Stored) and inner.relation not in ("handle", "snapshot"):
                raise RuleProblem(f"*{inner.relation} has no history: it can't be read inside at()")
            if isinstance(inner, S.Call):
                p = self.as_primitive(inner.name)
                if p is None or not p.in_history:
                    raise RuleProblem(f"{inner.name} has no history: it can't be used inside at()")
            if isinstance(inner, S.Aggregate):
                self.check_history(inner.body)
            if isinstance(inner, S.At):
                raise RuleProblem("at() blocks can't be nested")

    # Aggregates

    def aggregate(self, atom: S.Aggregate, frame: Frame, rest: list) -> Frame:
        given = dict(atom.args)
        allowed = S.WITH_ARGUMENTS.get(atom.fn, ())
        if len(given) < len(atom.args):
            raise RuleProblem(f"{atom.fn} is given an argument twice")
        if set(given) - set(allowed) or set(allowed) - set(given):
            raise RuleProblem(f"{atom.fn} takes {', '.join(allowed) or 'no arguments'}; it is given {', '.join(given) or 'none'}")
        keys = sorted(self.keys(atom, set(frame.names)))
        inner = self.alone(atom, frame, keys)
        if inner is None:
            seed = Frame(frame.df.select(*[f"v_{k}" for k in keys]).distinct(), tuple(keys)) if keys else Frame(None)
            inner = self.body(atom.body, seed)
        if inner.df is None:
            raise RuleProblem(f"{atom.fn} has an empty body")
        groups = [F.col(f"v_{k}") for k in keys]
        if atom.fn in S.WITH_ARGUMENTS:
            rows, kind = self.selected(atom, given, inner, keys, frame)
        else:
            value, kind = self.term(atom.value, inner)
            column, kind = self.summary(atom.fn, value, kind)
            # Without keys there is one group, also over no rows at all.
            rows = inner.df.groupBy(*groups).agg(column.alias("_result"), F.count("*").alias("_n"))
            if atom.fn != "Count":
                rows = rows.where("_n > 0")
            rows = rows.drop("_n")
        outside = frame.df
        if outside is None:
            joined = rows
        elif not keys:
            joined = outside.crossJoin(rows)
        else:
            other = rows.select(*[F.col(f"v_{k}").alias(f"r_{k}") for k in keys], "_result")
            on = None
            for k in keys:
                one = F.col(f"v_{k}").eqNullSafe(F.col(f"r_{k}"))
                on = one if on is None else on & one
            joined = outside.join(other, on, "left" if atom.fn == "Count" else "inner").drop(*[f"r_{k}" for k in keys])
            if atom.fn == "Count":
                joined = joined.withColumn("_result", F.coalesce("_result", F.lit(0).cast("long")))
        names = {n: frame.type(n) for n in frame.names}
        df = self.match(joined, F.col("_result"), kind, atom.result, names)
        if not names:
            return Frame(df.select(F.lit(True).alias("_one")), ())
        return Frame(df.select(*[F.col(f"v_{n}") for n in names]), tuple(names))

    def alone(self, atom: S.Aggregate, frame: Frame, keys: list[str]) -> Frame | None:
        """The body of a summary over one stored relation that has the keys itself: grouped as it is, tasks add up their
        own rows before they are dealt out, and a key of very many rows is in no single task. None: another body."""
        if not keys or atom.fn in S.WITH_ARGUMENTS or atom.fn == "List" or len(atom.body) != 1 or not isinstance(atom.body[0], S.Stored):
            return None
        terms = terms_of(atom.body[0])
        if not isinstance(atom.value, (S.Var, S.Lit)) or not all(isinstance(t, (S.Var, S.Lit, S.Wild)) for t in terms) or not set(keys) <= direct(terms):
            return None
        own = self.body(atom.body)
        # Equality of different kinds is the join's affair.
        return own if all(own.type(k) == frame.type(k) for k in keys) else None

    def summary(self, fn: str, value: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
        if fn == "Count":
            # In a struct, so that null is a value like any other.
            return F.count_distinct(F.struct(value.alias("v"))), T.LongType()
        if fn in ("Sum", "Avg"):
            if V.kind(kind) not in ("int", "float"):
                raise V.ValueProblem(f"{fn} needs numbers")
            if fn == "Avg":
                return F.avg(value.cast("double")), T.DoubleType()
            return (V.saturated_sum(value), T.LongType()) if V.kind(kind) == "int" else (F.sum(value), T.DoubleType())
        if fn in ("Min", "Max") and V.kind(kind) in ("bool", "int", "float"):
            # Without structs rows are hashed, not sorted. Null is the least value.
            return F.max(value) if fn == "Max" else F.when(F.count(value) == F.count("*"), F.min(value)), kind
        one = F.struct(value.alias("v"))
        if fn in ("Min", "Max"):
            return (F.min(one) if fn == "Min" else F.max(one))["v"], kind
        return F.transform(F.sort_array(F.collect_set(one)), lambda x: x["v"]), T.ArrayType(kind)

    def selected(self, atom: S.Aggregate, given: dict, inner: Frame, keys: list[str], frame: Frame) -> tuple[DataFrame, T.DataType]:
        """TopK, Rank and TakeUntil: the rows of each group that are chosen, as column _result."""
        parts = [F.col(f"v_{k}") for k in keys]
        key, _ = self.term(given["key"], inner)
        ranked = S.variables(given["rank"]) if atom.fn == "Rank" else set()
        df = inner.df.withColumn("_key", key)
        own = inner
        if atom.fn == "Rank":
            if not isinstance(given["rank"], S.Var):
                raise RuleProblem("Rank's rank is a variable")
            rank = F.dense_rank().over(Window.partitionBy(*parts).orderBy(F.col("_key").desc_nulls_last())) if parts else None
            df = df.withColumn(f"v_{given['rank'].name}", rank.cast("long")) if parts else self.context.ranked(df, "_key", f"v_{given['rank'].name}")
            own = Frame(df, inner.names + tuple(ranked - set(inner.names)))
        value, kind = self.term(atom.value, own)
        df = df.withColumn("_result", value)
        if atom.fn == "TopK":
            if not isinstance(given["k"], S.Lit) and not S.variables(given["k"]) <= set(keys):
                raise RuleProblem("TopK's k is bound outside the braces")
            k, kind_k = self.term(given["k"], own)
            if V.kind(kind_k) != "int" or isinstance(given["k"], S.Lit) and given["k"].value < 0:
                raise V.ValueProblem("TopK's k is an integer of 0 or more")
            order = [F.col("_key").desc_nulls_last(), F.col("_result").asc_nulls_first()]
            if not parts and isinstance(given["k"], S.Lit):
                df = df.orderBy(*order).limit(given["k"].value)
            else:
                df = df.withColumn("_k", k).withColumn("_at", F.row_number().over(Window.partitionBy(*parts).orderBy(*order))).where("_at <= _k")
        elif atom.fn == "TakeUntil":
            budget, kind_b = self.term(given["budget"], own)
            cost, kind_c = self.term(given["sum"], own)
            if V.kind(kind_b) != "int" or V.kind(kind_c) != "int":
                raise V.ValueProblem("TakeUntil's budget and sum are integers")
            bad = lambda c, what: F.when(c < 0, F.raise_error(F.lit(f"TakeUntil: negative {what}")).cast("long")).otherwise(c)
            order = [F.col("_key").asc_nulls_first(), F.col("_result").asc_nulls_first()]
            df = df.withColumn("_budget", bad(budget, "budget")).withColumn("_cost", bad(cost, "sum"))
            if parts:
                over = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
                df = df.withColumn("_sum", F.sum("_cost").over(over)).where("_sum <= _budget")
            else:
                df = self.context.taken(df, order)
        return df.select(*parts, "_result"), kind

    # Queries

    def query(self, query: S.Query) -> DataFrame:
        own = self
        if query.rules:
            program = S.Program(rules=list(query.rules))
            own = Compiler(self.context, Catalog.of(program), self)
            # A local rule may use a name of the program and hide it.
            own.catalog.optional = set()
        own.prepare_all(query)
        frame = own.body(query.body)
        rows = frame.rows(self.spark)
        order = []
        for t, down in query.order:
            missing = S.variables(t) - set(frame.names)
            if missing:
                raise RuleProblem(f"order by needs {', '.join(sorted(missing))} bound")
            c = own.term(t, frame)[0]
            order.append(c.desc_nulls_last() if down else c.asc_nulls_first())
        if order:
            rows = rows.orderBy(*order, *[F.col(f"v_{n}").asc_nulls_first() for n in sorted(frame.names)])
        return rows.select(*[F.col(f"v_{n}").alias(n) for n in sorted(frame.names)])

    def prepare_all(self, query: S.Query) -> None:
        roots = [c for c, _ in calls(query.body)]
        if self.outer:
            reach = self.catalog.demanded(roots)
            deeper = roots + [c for n in reach for r in self.catalog.rules[n] for c, _ in calls(r.body)]
            self.outer.prepare([c for c in deeper if c in self.outer.catalog.rules])
        self.prepare([c for c in roots if c in self.catalog.rules])
