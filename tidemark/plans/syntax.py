"""The rule language: tokens, syntax tree and parser.

A program is a sequence of statements, each ended by a dot: facts `p("a", 1).`, rules `p(x) := body.`,
queries `? body order by k.`, directives and annotations. A body is a comma list of stored atoms
`*relation{field: term}`, calls `p(a, b)`, patterns `p{a: x}`, comparisons, `not` atoms, aggregates
`n = Count{ value : body }` and time blocks `at("ref") { body }`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

AGGREGATES = ("Count", "Sum", "Min", "Max", "Avg", "List", "Set", "TopK", "Rank", "TakeUntil")
WITH_ARGUMENTS = {"TopK": ("k", "key"), "Rank": ("key", "rank"), "TakeUntil": ("budget", "sum", "key")}
WORD_OPERATORS = ("in", "contains", "starts_with", "ends_with", "matches")
SYMBOL_OPERATORS = ("=", "!=", "<=", ">=", "<", ">")
INT_MIN, INT_MAX = -(2**63), 2**63 - 1


class SyntaxProblem(ValueError):
    """A text that is no program, with the place."""


# Terms ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Wild:
    pass


@dataclass(frozen=True)
class Lit:
    value: Any  # str, int, float, bool, None or a tuple of literals (a list)


@dataclass(frozen=True)
class Tup:
    items: tuple


@dataclass(frozen=True)
class Bin:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Func:
    name: str
    args: tuple


# Atoms ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Stored:
    relation: str
    fields: tuple  # of (field, term)


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()
    named: tuple = ()  # of (parameter, term)
    pattern: bool = False  # p{a: x}: parameters left out are not asked for


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    atom: Any


@dataclass(frozen=True)
class At:
    ref: str
    body: tuple


@dataclass(frozen=True)
class Aggregate:
    result: Any
    fn: str
    args: tuple  # of (name, term)
    value: Any
    body: tuple


# Statements ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    name: str
    head: tuple
    body: tuple = ()
    source: str = ""
    line: int = 0
    layer: str = ""


@dataclass(frozen=True)
class Query:
    body: tuple
    order: tuple = ()  # of (term, descending)
    rules: tuple = ()
    text: str = ""


@dataclass(frozen=True)
class Annotation:
    kind: str  # doc, predicate or verb
    args: dict


@dataclass(frozen=True)
class Block:
    kind: str  # config or source
    name: str
    declarations: tuple  # of (name, args, named)
    line: int = 0


@dataclass(frozen=True)
class Load:
    kind: str  # include or import
    path: str
    module: str = ""
    line: int = 0


@dataclass
class Program:
    rules: list[Rule] = field(default_factory=list)
    queries: list[Query] = field(default_factory=list)
    annotations: list[Annotation] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    loads: list[Load] = field(default_factory=list)
    optional: list[Rule] = field(default_factory=list)

    def extend(self, other: Program) -> None:
        for name in ("rules", "queries", "annotations", "blocks", "loads", "optional"):
            getattr(self, name).extend(getattr(other, name))


_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+|\#[^\n]*)|(?P<string>"(?:\\[\s\S]|[^"\\\n])*")|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<mark>:=|!=|<=|>=|[?.,:(){}\[\]*+\-/%=<>@])"""
)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}


@dataclass(frozen=True)
class _Token:
    kind: str
    text: str
    line: int
    at: int


def _tokens(text: str) -> list[_Token]:
    out, at, line = [], 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            what = "unterminated string" if text[at] == '"' else f"unexpected character {text[at]!r}"
            raise SyntaxProblem(f"line {line}: {what}")
        if m.lastgroup != "space":
            out.append(_Token(m.lastgroup, m[0], line, at))
        line += m[0].count("\n")
        at = m.end()
    out.append(_Token("end", "", line, at))
    return out


class _Parser:
    def __init__(self, text: str, source: str):
        self.text, self.source, self.all, self.i = text, source, _tokens(text), 0

    # Small steps

    @property
    def now(self) -> _Token:
        return self.all[self.i]

    def ahead(self, n: int) -> _Token:
        return self.all[min(self.i + n, len(self.all) - 1)]

    def fail(self, what: str):
        found = self.now.text or "the end"
        raise SyntaxProblem(f"{self.source}, line {self.now.line}: expected {what}, found {found!r}")

    def is_(self, *texts: str) -> bool:
        return self.now.kind in ("mark", "name") and self.now.text in texts

    def eat(self, text: str) -> bool:
        if self.is_(text):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.eat(text):
            self.fail(repr(text))

    def name(self) -> str:
        token = self.now
        if token.kind != "name":
            self.fail("a name")
        if not (token.text[0].islower() or token.text[0] == "_"):
            self.fail("a name in lower case")
        self.i += 1
        return token.text

    def dotted(self) -> str:
        name = self.name()
        # `m.p(` names a predicate of a module; a dot before anything else ends the statement.
        while self.is_(".") and self.ahead(1).kind == "name" and self.ahead(2).text in ("(", "{") and self.ahead(1).at == self.now.at + 1:
            self.i += 1
            name += "." + self.name()
        return name

    def string(self) -> str:
        if self.now.kind != "string":
            self.fail("a string")
        raw = self.now.text[1:-1]
        self.i += 1
        return re.sub(r"\\([\s\S])", lambda m: _ESCAPES.get(m[1], m[1]), raw)

    def many(self, close: str, one) -> list:
        out = []
        while not self.is_(close):
            out.append(one())
            if not self.eat(","):
                break
        self.need(close)
        return out

    # Statements

    def program(self) -> Program:
        out = Program()
        while self.now.kind != "end":
            self.statement(out)
        return out

    def statement(self, out: Program) -> None:
        line = self.now.line
        if self.eat("?"):
            out.queries.append(self.query())
        elif self.is_("include") and self.ahead(1).kind == "string":
            self.i += 1
            out.loads.append(Load("include", self.string(), line=line))
            self.need(".")
        elif self.is_("import") and self.ahead(1).kind == "name":
            self.i += 1
            module = self.name()
            self.need("from")
            out.loads.append(Load("import", self.string(), module, line))
            self.need(".")
        elif self.is_("optional") and self.ahead(1).kind == "name":
            self.i += 1
            name, head = self.head()
            self.need(".")
            out.optional.append(Rule(name, head, (), self.source, line))
        elif self.is_("config", "source") and self.ahead(1).kind == "name" and self.ahead(2).text == "{":
            kind = self.name()
            section = self.name()
            self.need("{")
            found = []
            while not self.eat("}"):
                name = self.name()
                self.need("(")
                args, named = self.arguments(")")
                self.need(".")
                found.append((name, args, named))
            out.blocks.append(Block(kind, section, tuple(found), line))
        elif self.eat("@"):
            kind = self.name()
            if kind not in ("doc", "predicate", "verb"):
                self.fail("@doc, @predicate or @verb")
            self.need("(")
            args, named = self.arguments(")")
            self.need(".")
            if args or not all(isinstance(v, Lit) for _, v in named):
                self.fail(f"@{kind} with named literals")
            values = {k: v.value for k, v in named}
            if "name" not in values:
                self.fail(f"@{kind} with a name")
            out.annotations.append(Annotation(kind, values))
        else:
            name, head = self.head()
            body = () if self.is_(".") else None
            if body is None:
                self.need(":=")
                body = self.body(".")
            self.need(".")
            out.rules.append(Rule(name, head, body, self.source, line))

    def head(self) -> tuple[str, tuple]:
        name = self.dotted()
        self.need("(")
        return name, tuple(self.many(")", self.expression))

    def query(self) -> Query:
        rules, start = [], self.now.at
        while self.is_("where") and self.ahead(1).kind == "name":
            self.i += 1
            line = self.now.line
            name, head = self.head()
            self.need(":=")
            rules.append(Rule(name, head, self.body("."), self.source, line, "local"))
            self.need(".")
        body = self.body(".", ordered=True)
        order = []
        if self.is_("order") and self.ahead(1).text == "by":
            self.i += 2
            while True:
                key = self.expression()
                down = self.eat("desc")
                if not down:
                    self.eat("asc")
                order.append((key, down))
                if not self.eat(","):
                    break
        text = self.text[start : self.now.at]
        self.need(".")
        return Query(body, tuple(order), tuple(rules), text)

    def body(self, close: str, ordered: bool = False) -> tuple:
        at_order = lambda: ordered and self.is_("order") and self.ahead(1).text == "by"
        atoms = []
        while True:
            if self.is_(close) or at_order():
                self.fail("an atom")
            atoms.append(self.atom())
            if not self.eat(","):
                return tuple(atoms)

    # Atoms

    def atom(self):
        if self.is_("not") and (self.ahead(1).text == "*" or self.ahead(1).kind == "name"):
            self.i += 1
            return Not(self.stored() if self.is_("*") else self.call())
        if self.is_("*"):
            return self.stored()
        if self.is_("at") and self.ahead(1).text == "(":
            self.i += 2
            ref = self.string()
            self.need(")")
            self.need("{")
            body = self.body("}")
            self.need("}")
            return At(ref, body)
        if self.now.kind == "name" and not self.is_("true", "false", "null"):
            mark = self.i
            try:
                found = self.call()
            except SyntaxProblem:
                found = None
            if found and not (self.is_(*SYMBOL_OPERATORS, *WORD_OPERATORS, "+", "-", "*", "/", "%")):
                return found
            self.i = mark
        left = self.expression()
        if self.is_("=") and self.ahead(1).text in AGGREGATES and self.ahead(2).text == "{":
            self.i += 1
            return self.aggregate(left)
        if not self.is_(*SYMBOL_OPERATORS, *WORD_OPERATORS):
            self.fail("a comparison")
        op = self.now.text
        self.i += 1
        return Compare(op, left, self.expression())

    def aggregate(self, result) -> Aggregate:
        fn = self.now.text
        self.i += 1
        self.need("{")
        args = ()
        if fn in WITH_ARGUMENTS and self.now.kind == "name" and self.ahead(1).text == ":":
            args = tuple(self.many(":", lambda: self.pair("an argument")))
        value = self.expression()
        self.need(":")
        body = self.body("}")
        self.need("}")
        return Aggregate(result, fn, args, value, body)

    def pair(self, what: str) -> tuple[str, Any]:
        if self.now.kind != "name":
            self.fail(what)
        name = self.name()
        self.need(":")
        return name, self.expression()

    def stored(self) -> Stored:
        self.need("*")
        relation = self.name()
        self.need("{")

        def one():
            name = self.name()
            return (name, self.expression()) if self.eat(":") else (name, Var(name))

        fields = self.many("}", one)
        if len({k for k, _ in fields}) < len(fields):
            raise SyntaxProblem(f"*{relation} names a field twice")
        return Stored(relation, tuple(fields))

    def call(self) -> Call:
        name = self.dotted()
        if self.eat("{"):

            def one():
                name = self.name()
                return (name, self.expression()) if self.eat(":") else (name, Var(name))

            return Call(name, (), tuple(self.many("}", one)), True)
        self.need("(")
        args, named = self.arguments(")")
        return Call(name, args, named)

    def arguments(self, close: str) -> tuple[tuple, tuple]:
        args, named = [], []
        while not self.is_(close):
            if self.now.kind == "name" and self.ahead(1).text == ":":
                named.append(self.pair("a parameter"))
            elif named:
                self.fail("a named argument after another")
            else:
                args.append(self.expression())
            if not self.eat(","):
                break
        self.need(close)
        return tuple(args), tuple(named)

    # Expressions

    def expression(self, least: int = 0):
        left = self.primary()
        while True:
            op = self.now.text if self.now.kind == "mark" else ""
            rank = {"+": 1, "-": 1, "*": 2, "/": 2, "%": 2}.get(op, 0)
            if rank <= least:
                return left
            self.i += 1
            left = Bin(op, left, self.expression(rank))

    def primary(self):
        token = self.now
        if token.kind == "string":
            return Lit(self.string())
        if token.kind == "number":
            self.i += 1
            return self.number(token.text, False)
        if self.is_("-") and self.ahead(1).kind == "number":
            self.i += 2
            return self.number(self.all[self.i - 1].text, True)
        if self.eat("("):
            items = self.many(")", self.expression)
            return items[0] if len(items) == 1 else Tup(tuple(items))
        if self.eat("["):
            items = self.many("]", self.expression)
            if not all(isinstance(x, Lit) for x in items):
                self.fail("a list of literals")
            return Lit(tuple(x.value for x in items))
        if token.kind == "name":
            if token.text in ("true", "false", "null"):
                self.i += 1
                return Lit({"true": True, "false": False, "null": None}[token.text])
            if token.text == "_":
                self.i += 1
                return Wild()
            name = self.dotted()
            if self.eat("("):
                return Func(name, tuple(self.many(")", self.expression)))
            return Var(name)
        self.fail("a term")

    def number(self, text: str, negative: bool) -> Lit:
        value = float(text) if "." in text else int(text)
        value = -value if negative else value
        if isinstance(value, int) and not INT_MIN <= value <= INT_MAX:
            raise SyntaxProblem(f"{self.source}, line {self.now.line}: numeric literal is out of range")
        return Lit(value)


def parse(text: str, source: str = "inline") -> Program:
    return _Parser(text, source).program()


def renamed(rule: Rule, names: dict[str, str]) -> Rule:
    """The rule with predicates renamed in head and body."""

    def of(x):
        if isinstance(x, Call):
            return replace(x, name=names.get(x.name, x.name))
        if isinstance(x, Not):
            return Not(of(x.atom))
        if isinstance(x, (At, Aggregate)):
            return replace(x, body=tuple(map(of, x.body)))
        return x

    return replace(rule, name=names.get(rule.name, rule.name), body=tuple(map(of, rule.body)))


def variables(x) -> set[str]:
    """Variables of a term or atom; those inside aggregates and negations as well."""
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, (Tup, Func)):
        return set().union(*map(variables, x.items if isinstance(x, Tup) else x.args))
    if isinstance(x, (Bin, Compare)):
        return variables(x.left) | variables(x.right)
    if isinstance(x, Stored):
        return set().union(*(variables(t) for _, t in x.fields))
    if isinstance(x, Call):
        return set().union(*map(variables, x.args), *(variables(t) for _, t in x.named))
    if isinstance(x, Not):
        return variables(x.atom)
    if isinstance(x, At):
        return set().union(*map(variables, x.body))
    if isinstance(x, Aggregate):
        return set().union(variables(x.result), variables(x.value), *(variables(t) for _, t in x.args), *map(variables, x.body))
    return set()


def revariabled(x, names: dict[str, str]):
    """x with its variables named otherwise."""
    if isinstance(x, Var):
        return Var(names.get(x.name, x.name))
    if isinstance(x, tuple):
        return tuple(revariabled(i, names) for i in x)
    if hasattr(x, "__dataclass_fields__") and not isinstance(x, Lit):
        return replace(x, **{f: revariabled(getattr(x, f), names) for f in x.__dataclass_fields__})
    return x
