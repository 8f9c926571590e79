"""The standard library: predicates over handles, edges, metadata, configuration and snapshots.

`install(engine)` makes them callable from rules and queries. Each is a lazy DataFrame plan that is built only
when a query reaches it; a predicate that rules define replaces the library's, for the library's own plans too.
"""

from __future__ import annotations

from ..plans.compiler import Primitive
from . import checks, convergence, orientation, structure, topic, views
from .base import REGISTRY, Library
from .verbs import VERBS

__all__ = ["REGISTRY", "Library", "checks", "convergence", "install", "orientation", "structure", "topic", "views"]

def _build(name: str):
    def build(ctx):
        lib = getattr(ctx, "_library", None)
        if lib is None or lib.version is not ctx.version:
            lib = ctx._library = Library(ctx)
            lib.version = ctx.version
        df = lib(name)
        return df.toDF(*[f"p{i}" for i in range(len(df.columns))])

    return build


def install(engine) -> None:
    engine.load(VERBS, "library", "library")
    engine.primitives = engine.primitives | {s.name: Primitive(s.name, s.params, _build(s.name), soft=not s.protected, doc=s.doc) for s in REGISTRY.values()}
