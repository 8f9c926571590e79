"""Configuration blocks as rows of *config."""

from __future__ import annotations

from ..plans import syntax as S

#: Keys whose values form an ordered list.
ORDERED = {"convergence.ordering"}


def rows(blocks: list[S.Block], corpus: str = "") -> list[dict]:
    """`config section { key(values). }` gives one row per value under `section.key`; list values of ordered
    keys bear ordinals from 0, and tuples are joined as key.first = second."""
    out = []
    for b in blocks:
        if b.kind != "config":
            continue
        for name, args, named in b.declarations:
            key = f"{b.name}.{name}"
            values = []
            for a in args:
                if not isinstance(a, S.Lit):
                    raise S.SyntaxProblem(f"line {b.line}: config {key} takes literals")
                values += list(a.value) if isinstance(a.value, tuple) else [a.value]
            text = [v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v) for v in values]
            if len(args) == 2 and not any(isinstance(a.value, tuple) for a in args) and not named:
                out.append({"corpus": corpus, "key": f"{key}.{text[0]}", "value": text[1], "ordinal": None})
                continue
            for i, v in enumerate(text):
                out.append({"corpus": corpus, "key": key, "value": v, "ordinal": i if key in ORDERED else None})
    return out
