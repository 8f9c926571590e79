"""Values of the rule language as Spark columns: kinds, equality, order and arithmetic.

Equality is total (null equals null, values of different kinds differ, 1 and 1.0 too), and the order runs
null < bool < int < float < string < list. Columns have static types, so the kind of a comparison is settled
when the plan is made and most comparisons are one native operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANK = {"null": 0, "bool": 1, "int": 2, "float": 3, "string": 4, "list": 5}


class ValueProblem(TypeError):
    """An operator on values of a kind it has no meaning for."""


def kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NullType):
        return "null"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, T.FractionalType):
        return "float"
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, (T.ArrayType, T.StructType)):
        return "list"
    raise ValueProblem(f"no value of the language has the type {data_type.simpleString()}")


def literal(value) -> tuple[Column, T.DataType]:
    if value is None:
        return F.lit(None), T.NullType()
    if isinstance(value, bool):
        return F.lit(value), T.BooleanType()
    if isinstance(value, int):
        return F.lit(value).cast("long"), T.LongType()
    if isinstance(value, float):
        return F.lit(value), T.DoubleType()
    if isinstance(value, str):
        return F.lit(value), T.StringType()
    items = [literal(x) for x in value]
    kinds = {t for _, t in items}
    if len(kinds) > 1:
        return F.struct(*[c.alias(f"_{i + 1}") for i, (c, _) in enumerate(items)]), T.StructType([T.StructField(f"_{i + 1}", t) for i, (_, t) in enumerate(items)])
    inner = kinds.pop() if kinds else T.NullType()
    return F.array(*[c for c, _ in items]), T.ArrayType(inner)


def plain(df: DataFrame) -> DataFrame:
    """A table's columns as values of the language: integers are long, other numbers double, and dates and
    timestamps ISO strings."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.IntegralType) and not isinstance(t, T.LongType):
            c = c.cast("long")
        elif isinstance(t, T.FractionalType) and not isinstance(t, T.DoubleType):
            c = c.cast("double")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def comparable(a: T.DataType, b: T.DataType) -> bool:
    """Whether one native operator compares the two types."""
    ka, kb = kind(a), kind(b)
    if ka != kb or ka == "null":
        return False
    return ka != "list" or a.simpleString() == b.simpleString() or isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType) and comparable(a.elementType, b.elementType)


def equal(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    if comparable(ta, tb):
        return a.eqNullSafe(b)
    return a.isNull() & b.isNull()


def less(a: Column, ta: T.DataType, b: Column, tb: T.DataType, or_equal: bool) -> Column:
    if comparable(ta, tb):
        native = (a <= b) if or_equal else (a < b)
        return F.when(a.isNull(), F.lit(True) if or_equal else b.isNotNull()).when(b.isNull(), F.lit(False)).otherwise(native)
    ra, rb = RANK[kind(ta)], RANK[kind(tb)]
    return F.when(a.isNull(), F.lit(True) if or_equal else b.isNotNull()).when(b.isNull(), F.lit(False)).otherwise(F.lit(ra < rb))


def compare(op: str, a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    if op == "=":
        return equal(a, ta, b, tb)
    if op == "!=":
        return ~equal(a, ta, b, tb)
    if op in ("<", "<="):
        return less(a, ta, b, tb, op == "<=")
    if op in (">", ">="):
        return less(b, tb, a, ta, op == ">=")
    if op == "in":
        if not isinstance(tb, (T.ArrayType, T.StructType)):
            raise ValueProblem("`in` needs a list on its right")
        return member(a, ta, b, tb)
    if op == "contains":
        if isinstance(ta, (T.ArrayType, T.StructType)):
            return member(b, tb, a, ta)
        if kind(ta) == kind(tb) == "string":
            return F.coalesce(F.contains(a, b), F.lit(False))
        raise ValueProblem("`contains` needs strings, or a list on its left")
    if op in ("starts_with", "ends_with"):
        if not {kind(ta), kind(tb)} <= {"string", "null"}:
            raise ValueProblem(f"`{op}` needs strings")
        return F.coalesce(F.startswith(a, b) if op == "starts_with" else F.endswith(a, b), F.lit(False))
    raise ValueProblem(f"`{op}` can't be planned; use the match primitive for regular expressions")


def member(a: Column, ta: T.DataType, items: Column, ti: T.DataType) -> Column:
    if isinstance(ti, T.StructType):
        out = F.lit(False)
        for f in ti.fields:
            out = out | equal(a, ta, items[f.name], f.dataType)
        return out
    return F.coalesce(F.exists(items, lambda x: equal(a, ta, x, ti.elementType)), F.lit(False))


def arithmetic(op: str, a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> tuple[Column, T.DataType]:
    if not {kind(ta), kind(tb)} <= {"int", "float"}:
        raise ValueProblem(f"`{op}` needs numbers")
    if kind(ta) == kind(tb) == "int":
        out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b, "/": lambda: F.call_function("div", a, b)}[op]()
        return out.cast("long"), T.LongType()
    a, b = a.cast("double"), b.cast("double")
    out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b, "/": lambda: a / b}[op]()
    return out, T.DoubleType()


def saturated_sum(c: Column) -> Column:
    """The sum of a long column, held at the ends of its range. High and low halves are summed apart, so that
    partial sums stay native longs."""
    high, low = F.sum(F.shiftright(c, 32)), F.sum(c.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    total = high.cast("decimal(38,0)") * F.lit(2**32).cast("decimal(11,0)") + low.cast("decimal(38,0)")
    return F.least(F.greatest(total, F.lit(-(2**63)).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")


def canonical(c: Column, t: T.DataType) -> Column:
    """JSON text of a value, for columns whose clauses differ in shape."""
    if isinstance(t, T.StringType):
        return F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    if isinstance(t, T.StructType):
        parts = [F.coalesce(canonical(c[f.name], f.dataType), F.lit("null")) for f in t.fields]
        return F.when(c.isNotNull(), F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")))
    if isinstance(t, T.ArrayType):
        return F.to_json(c)
    return c.cast("string")


def union(frames: list[DataFrame]) -> DataFrame:
    """Union by position. Columns that differ only by an untyped null take the other type; columns of strings,
    tuples and lists of several shapes become JSON text; other mixtures are an error."""
    width = {len(f.columns) for f in frames}
    if len(width) > 1:
        raise ValueProblem("clauses of one predicate differ in their number of columns")
    types: list = []
    for i in range(width.pop()):
        seen = {f.schema.fields[i].dataType.simpleString(): f.schema.fields[i].dataType for f in frames if not isinstance(f.schema.fields[i].dataType, T.NullType)}
        if len(seen) <= 1:
            types.append(next(iter(seen.values()), T.NullType()))
        elif {kind(t) for t in seen.values()} <= {"string", "list"}:
            types.append(None)
        elif len({kind(t) for t in seen.values()}) == 1 and kind(next(iter(seen.values()))) in ("int", "float"):
            types.append(T.LongType() if kind(next(iter(seen.values()))) == "int" else T.DoubleType())
        else:
            raise ValueProblem(f"column {i + 1} holds {' and '.join(sorted(seen))}")
    out = None
    for f in frames:
        columns = []
        for name, want, field in zip(frames[0].columns, types, f.schema.fields, strict=True):
            c = F.col(f"`{field.name}`")
            if want is None:
                c = F.lit(None).cast("string") if isinstance(field.dataType, T.NullType) else canonical(c, field.dataType)
            elif field.dataType != want:
                c = c.cast(want)
            columns.append(c.alias(name))
        f = f.select(*columns)
        out = f if out is None else out.union(f)
    return out
