"""Budgeted reads and pattern search over content spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tokens that read_full may return, and characters a clipped token stands for.
FULL_LIMIT = 8000
CHARS_PER_TOKEN = 4


def spans(ctx) -> DataFrame:
    """handle, span_id, text, tokens, start_line, end_line of every content row; content without a span row
    starts at line 1."""
    c = ctx.relation("content").select("corpus", "source", "handle", "span_id", "text", "tokens", "lines")
    s = ctx.relation("span").select("corpus", "source", F.col("handle").alias("h"), F.col("id").alias("s"), "start_line", "end_line")
    on = (c.corpus == s.corpus) & (c.source == s.source) & (c.handle == s.h) & (c.span_id == s.s)
    joined = c.join(s, on, "left")
    start = F.coalesce("start_line", F.lit(1).cast("long"))
    return joined.select("handle", "span_id", "text", "tokens", start.alias("start_line"), F.coalesce("end_line", start + F.greatest(F.col("lines") - 1, F.lit(0).cast("long"))).alias("end_line"))


def read(ctx, seeds: DataFrame) -> DataFrame:
    """(handle, budget, span_id, text, start_line, end_line, tokens): spans in source order while their tokens
    fit; a first span that doesn't is clipped."""
    budget = F.when(F.col("p1") < 0, F.raise_error(F.lit("read: negative budget")).cast("long")).otherwise(F.col("p1"))
    named = "p2" in seeds.columns
    asked = seeds.select(F.col("p0").alias("handle"), budget.alias("budget"), *([F.col("p2").alias("want")] if named else []))
    rows = asked.join(spans(ctx), "handle")
    if named:
        rows = rows.where("span_id = want").drop("want")
    order = Window.partitionBy("handle", "budget").orderBy("start_line", "end_line", "span_id")
    total = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("total", total).withColumn("at", F.row_number().over(order))
    clip = (F.col("at") == 1) & (F.col("tokens") > F.col("budget"))
    rows = rows.where((F.col("total") <= F.col("budget")) | clip)
    text = F.when(clip, F.concat(F.expr(f"substring(text, 1, cast(budget * {CHARS_PER_TOKEN} as int))"), F.lit("\n..."))).otherwise(F.col("text"))
    tokens = F.when(clip, F.col("budget")).otherwise(F.col("tokens"))
    return rows.select(F.col("handle").alias("p0"), F.col("budget").alias("p1"), F.col("span_id").alias("p2"), text.alias("p3"), F.col("start_line").alias("p4"), F.col("end_line").alias("p5"), tokens.alias("p6"))


def read_full(ctx, seeds: DataFrame) -> DataFrame:
    """(handle, content): all spans joined by newlines; an error beyond the token limit."""
    ctx.require("ReadFull")
    rows = seeds.select(F.col("p0").alias("handle")).distinct().join(spans(ctx), "handle")
    sums = rows.groupBy("handle").agg(F.sum("tokens").alias("n"))
    fits = sums.where(F.when(F.col("n") > FULL_LIMIT, F.raise_error(F.concat(F.lit("read_full: more than "), F.lit(str(FULL_LIMIT)), F.lit(" tokens in "), F.col("handle"))).cast("boolean")).otherwise(F.lit(True)))
    parts = rows.join(fits.select("handle"), "handle").groupBy("handle").agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "span_id", "text"))).alias("parts"))
    return parts.select(F.col("handle").alias("p0"), F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("p1"))


def match(ctx, seeds: DataFrame) -> DataFrame:
    """(pattern, handle, line, snippet): each line of each span that a regular expression matches."""
    ctx.require("Match")
    asked = seeds.select(F.col("p0").alias("pattern"), F.col("p1").alias("handle")).distinct()
    lines = asked.join(spans(ctx), "handle").select("pattern", "handle", "start_line", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    hits = lines.where(F.expr("line rlike pattern"))
    return hits.select(F.col("pattern").alias("p0"), F.col("handle").alias("p1"), (F.col("start_line") + F.col("at")).alias("p2"), F.col("line").alias("p3"))
