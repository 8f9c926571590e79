"""Front matter: the block between two lines of three hyphens, in the part of YAML that documents use.

Values are strings. Plain, quoted, literal and folded scalars, lists in brackets (over several lines too) and lists of
items are read; a nested mapping has no values of its own, and neither has null. A note in parentheses at the end of a value
("a.md (the first plan)") is no part of it.
"""

from __future__ import annotations

import re

FENCE = "---"
_KEY = re.compile(r"""(?:"([^"]*)"|'([^']*)'|([^\s\-#"'\[\]{}][^:#]*?|-[^\s:#][^:#]*?))\s*:(?:\s+(.*)|)$""")
_ITEM = re.compile(r"\s*-(?:\s+(.*)|)$")
_NOTE = re.compile(r"\s\([^()]*\)$")
_NULL = {"", "~", "null", "Null", "NULL"}


def split(lines: list[str]) -> tuple[list[str], int]:
    """The lines of the front matter, and how many lines it takes with its fences; none without a second fence."""
    if not lines or lines[0].rstrip("\r") != FENCE:
        return [], 0
    for n, line in enumerate(lines[1:], 1):
        if line.rstrip("\r") == FENCE:
            return [x.rstrip("\r") for x in lines[1:n]], n + 1
    return [], 0


def _uncommented(text: str) -> str:
    """The text before a comment that stands outside quotes."""
    quote = ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and (i == 0 or text[i - 1] in " \t[,"):
            quote = c
        elif c == "#" and (i == 0 or text[i - 1] in " \t"):
            return text[:i].rstrip()
    return text.strip()


def scalar(text: str) -> str | None:
    """One scalar as a string; None for null and for mappings in braces."""
    text = text.strip()
    if text in _NULL or text.startswith("{"):
        return None
    if len(text) > 1 and text[0] == text[-1] == "'":
        text = text[1:-1].replace("''", "'")
    elif len(text) > 1 and text[0] == text[-1] == '"':
        text = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
    elif text.lower() in ("true", "false"):
        text = text.lower()
    return _NOTE.sub("", text.strip())


def _flow(text: str) -> list[str]:
    """The scalars of a list in brackets, with those of lists in it."""
    out, held, quote = [], "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and not held.strip():
            quote = c
        elif c in "[],":
            out.append(held)
            held = ""
            continue
        held += c
    return [v for v in map(scalar, [*out, held]) if v is not None]


def _block(lines: list[str], folded: bool) -> str:
    """A literal or folded scalar of lines that are all indented."""
    own = [x for x in lines if x.strip()]
    margin = min((len(x) - len(x.lstrip(" ")) for x in own), default=0)
    text = "\n".join(x[margin:] for x in lines).strip("\n")
    return re.sub(r"(?<!\n)\n(?!\n)", " ", text) if folded else text


def parse(lines: list[str]) -> dict[str, list[str]]:
    """Each key of the outermost mapping with its values, in the order of the lines."""
    out: dict[str, list[str]] = {}
    n = 0
    while n < len(lines):
        line, n = lines[n], n + 1
        m = _KEY.match(_uncommented(line)) if line[:1] not in (" ", "\t") else None
        if not m:
            continue
        key, value = next(k for k in m.groups()[:3] if k is not None), (m[4] or "").strip()
        # What belongs to the key: deeper lines, and items that stand at its own depth.
        inner = []
        while n < len(lines) and (not lines[n].strip() or lines[n][0] in " \t" or not value and _ITEM.match(lines[n])):
            inner.append(lines[n])
            n += 1
        if re.fullmatch(r"[|>][-+0-9]*", value):
            text = scalar(_block(inner, value[0] == ">"))
            out[key] = [] if text is None else [text]
        elif value.startswith("["):
            out[key] = _flow(" ".join([value, *map(_uncommented, inner)]))
        elif value:
            text = scalar(" ".join([value, *(x for x in map(_uncommented, inner) if x)]))
            out[key] = [] if text is None else [text]
        else:
            items = [_ITEM.match(x) for x in map(_uncommented, inner) if x]
            listed = bool(items) and items[0] is not None
            found = [scalar(i[1] or "") for i in items if i and not _KEY.match(i[1] or "")] if listed else []
            out[key] = [v for v in found if v is not None]
    return out
