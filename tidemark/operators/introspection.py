"""Rows about the engine itself: relations, predicates, verbs, sources and host capabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources import schema as tables


def quoted(value) -> str:
    """A value as a literal of the language."""
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, (int, float)):
        return repr(value)
    return '"' + str(value).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def _docs(ctx) -> dict[str, str]:
    return {a.args["name"]: str(a.args.get("text") or a.args.get("doc") or "") for a in ctx.program.annotations if a.kind == "doc"}


def _defined(ctx) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in ctx.program.rules:
        out.setdefault(r.name, []).append(r)
    return out


def schema(ctx) -> DataFrame:
    rows = [(f"*{n}", "stored", f"*{n}{{{', '.join(ctx.relation(n).columns)}}}", "deterministic", "facts") for n in sorted({*tables.FIELDS, *ctx.relations, *ctx.pending})]
    rows += [(p.name, "primitive", f"{p.name}({', '.join(p.params)})", "deterministic", "engine") for p in ctx.primitives.values()]
    rows += [(n, "derived", f"{n}/{len(rs[0].head)}", "deterministic", rs[0].source) for n, rs in sorted(_defined(ctx).items())]
    return ctx.local(rows, "p0 string, p1 string, p2 string, p3 string, p4 string")


def predicates(ctx) -> DataFrame:
    docs = _docs(ctx)
    rows = [(n, docs.get(n, ""), rs[0].source, ",".join(str(r.line) for r in rs)) for n, rs in sorted(_defined(ctx).items())]
    return ctx.local(rows, "p0 string, p1 string, p2 string, p3 string")


def verbs(ctx) -> DataFrame:
    rows = [(a.args["name"], str(a.args.get("query", "")), str(a.args.get("doc", "")), str(a.args.get("output_schema", ""))) for a in ctx.program.annotations if a.kind == "verb"]
    return ctx.local(rows, "p0 string, p1 string, p2 string, p3 string")


def describe(ctx) -> DataFrame:
    rows = [(p.name, p.doc) for p in ctx.primitives.values()]
    rows += [(n, t) for n, t in sorted(_docs(ctx).items())]
    rows += [(a.args["name"], str(a.args.get("doc", ""))) for a in ctx.program.annotations if a.kind == "verb"]
    return ctx.local(rows, "p0 string, p1 string").distinct()


def source_of(ctx) -> DataFrame:
    rows = [(n, r.source, str(r.line)) for n, rs in sorted(_defined(ctx).items()) for r in rs]
    return ctx.local(rows, "p0 string, p1 string, p2 string")


def examples(ctx) -> DataFrame:
    rows = [(p.name, f"? {p.name}({', '.join(p.params)}).") for p in ctx.primitives.values() if not p.needs]
    rows += [(f"*{n}", f"? *{n}{{{', '.join(tables.fields(n)[-3:])}}}.") for n in tables.FIELDS]
    return ctx.local(rows, "p0 string, p1 string")


def sources(ctx) -> DataFrame:
    rows = [
        ("md", "**/*.md", "Extract,Read,Search", "markdown documents with front matter, links and labels"),
        ("code", "source trees", "Extract,Search", "source files, their classes and notes"),
        ("tables", "any table Spark reads", "Extract", "rows of registered tables"),
    ]
    return ctx.local(rows, "p0 string, p1 string, p2 string, p3 string")


def repository(ctx) -> DataFrame:
    known = "git_mtimes" in {*ctx.relations, *ctx.pending}
    rows = [("mtimes", "available" if known else "unavailable", "injected", "" if known else "no git_mtimes relation is registered")]
    return ctx.local(rows, "p0 string, p1 string, p2 string, p3 string")
