"""What to read first: currency, recency and anchors."""

from pyspark.sql import functions as F

from .base import Library, counted, edges, marked, predicate, table, top, union, within, without

#: Ends of names of files that lead to others.
HUBS = ["README.md", "INDEX.md", "index.md", "overview.md", "glossary.md", "roadmap.md", "OPEN-QUESTIONS.md", "LABELS.md"]
table("change_recency_frontier_score", "band score", "composition", "What an age band counts for, in days.", [("7d", 45), ("30d", 90), ("90d", 180), ("365d", 365)])
table(
    "anchor_status_policy", "status required_classification score priority why", "composition", "Statuses that make an anchor if they have the class required.",
    [("authoritative", "settled", 250, 0, "authoritative_status"), ("current", "settled", 150, 1, "authoritative_status"), ("living", "settled", 150, 1, "authoritative_status"), ("live", "active", 150, 1, "authoritative_status"), ("stable", "settled", 120, 2, "authoritative_status"), ("reference", "active", 70, 3, "authoritative_status")],
)


@predicate("orientation_file", "h file", "structure")
def orientation_file(lib: Library):
    """Files."""
    return lib.handles(kind="file").where("file <> ''")


def _classed(lib, name: str):
    of = lib("lifecycle_status_classification").where(F.col("classification") == name)
    return within(lib("status_of"), of, "status")


@predicate("orientation_retired_status", "h", "lifecycle")
def orientation_retired_status(lib):
    """Handles of a terminal status."""
    return _classed(lib, "terminal")


@predicate("orientation_replaced", "h", "currency")
def orientation_replaced(lib):
    """Handles that are superseded or retired."""
    return union(edges(lib, "Supersedes", "h").select("h"), lib("orientation_retired_status"))


@predicate("operative", "h", "lifecycle")
def operative(lib):
    """Files of a settled status."""
    return within(lib("orientation_file"), _classed(lib, "settled"), "h")


@predicate("currency_superseded", "h", "currency")
def currency_superseded(lib):
    """Files that another supersedes."""
    return within(lib("orientation_file"), edges(lib, "Supersedes", "h"), "h")


@predicate("currency_successor", "h", "currency")
def currency_successor(lib):
    """Files that supersede another."""
    return within(lib("orientation_file"), edges(lib, "Supersedes", dst="h"), "h")


@predicate("currency_current", "h", "currency")
def currency_current(lib):
    """Files that nothing supersedes."""
    return without(lib("orientation_file"), lib("currency_superseded"), "h")


@predicate("currency_current_head", "h", "currency")
def currency_current_head(lib):
    """Heads of successions."""
    return without(lib("currency_successor"), lib("currency_superseded"), "h")


@predicate("currency_disposition", "h disposition", "currency")
def currency_disposition(lib):
    """superseded, current_head, current or unknown."""
    of = marked(known=lib.handles(), gone=lib("currency_superseded"), head=lib("currency_current_head"), here=lib("currency_current"))
    # A null equals no other, as in joins.
    c, null = F.col, F.col("h").isNull()
    says = lambda when, what: F.when(when, F.lit(what))
    found = F.array(
        says(c("gone"), "superseded"),
        says(c("head"), "current_head"),
        says(c("here") & (null | ~c("head")), "current"),
        says(c("known") & (null | ~(c("here") | c("gone"))), "unknown"),
    )
    return of.select("h", F.explode(F.array_compact(found)).alias("disposition"))


@predicate("orientation_inbound_count", "h degree", "importance")
def orientation_inbound_count(lib):
    """Distinct sources of edges to each file."""
    return counted(lib("orientation_file"), ["h"], edges(lib, dst="h"), "src", "degree")


@predicate("orientation_curated_hub", "h", "structure")
def orientation_curated_hub(lib):
    """Files with the name of a hub."""
    return lib("orientation_file").where(F.col("file").rlike("(" + "|".join(n.replace(".", "[.]") for n in HUBS) + ")$"))


@predicate("orientation_historical_file", "h", "lifecycle")
def orientation_historical_file(lib):
    """Files in archives."""
    return lib("orientation_file").where(F.col("file").rlike("^archive/|/archive/|/history/"))


@predicate("authored_age", "h days", "recency")
def authored_age(lib):
    """Days since the date of dated handles."""
    return within(lib("freshness"), lib.handles().where("date is not null"), "h")


@predicate("recent_frontier_authored_age", "h days", "composition")
def recent_frontier_authored_age(lib):
    """Those of a year at most."""
    return lib("authored_age").where("days <= 365")


@predicate("changed_recently", "h band", "recency")
def changed_recently(lib):
    """Undated handles by how long ago their file changed."""
    days = [7, 30, 90, 365]
    touched = lib.bound("changed_within", days=days)
    of = marked(undated=lib.handles().where("date is null"), **{f"in{d}": touched.where(F.col("days") == d) for d in days})
    bands = [F.when(F.col(f"in{d}") & ~F.col(f"in{before}") if before else F.col(f"in{d}"), F.lit(f"{d}d")) for before, d in zip([None, *days], days)]
    return of.where("undated and h is not null").select("h", F.explode(F.array_compact(F.array(*bands))).alias("band"))


@predicate("recent_frontier_change_score", "h score", "composition")
def recent_frontier_change_score(lib):
    """What that counts for."""
    return lib("changed_recently").join(lib("change_recency_frontier_score"), "band")


@predicate("recent_active_boost", "h boost", "composition")
def recent_active_boost(lib):
    """200 for active files with a status, 0 for terminal ones and those without."""
    of = marked(file=lib("orientation_file"), stated=lib("status_of"), bare=lib.handles().where("status is null"), active=lib("active"), terminal=lib("terminal"))
    c, value = F.col, lambda when, n: F.when(when, F.lit(n).cast("long"))
    found = F.array(value(c("stated") & c("active"), 200), value(c("bare") | (c("stated") & c("terminal")), 0))
    return of.where("file and h is not null").select("h", F.explode(F.array_compact(found)).alias("boost"))


@predicate("recent_inbound_boost", "h boost", "composition")
def recent_inbound_boost(lib):
    """8, 4 or 0 by the number of sources."""
    return lib("orientation_inbound_count").withColumn("boost", F.when(F.col("degree") >= 20, 8).when(F.col("degree") >= 10, 4).otherwise(0).cast("long"))


@predicate("recent_curated_penalty", "h penalty", "composition")
def recent_curated_penalty(lib):
    """5000 for hubs, 0 for other files."""
    of = marked(file=lib("orientation_file"), hub=lib("orientation_curated_hub")).where("file")
    return of.select("h", F.when(F.col("hub") & F.col("h").isNotNull(), 5000).otherwise(0).cast("long").alias("penalty"))


@predicate("recent_frontier_candidate", "h recency active_boost inbound_boost curated_penalty", "composition")
def recent_frontier_candidate(lib):
    """Files of known recency that are neither terminal nor replaced."""
    recency = union(lib("recent_frontier_authored_age", "h", "recency"), lib("recent_frontier_change_score", "h", "recency"))
    rows = recency.join(lib("recent_active_boost", "h", "active_boost"), "h").join(lib("recent_inbound_boost", "h", "inbound_boost"), "h").join(lib("recent_curated_penalty", "h", "curated_penalty"), "h")
    return without(without(rows, lib("terminal"), "h"), lib("orientation_replaced"), "h")


@predicate("recent_frontier_ranked", "h rank recency", "composition")
def recent_frontier_ranked(lib):
    """Their dense rank by recency, boosts and penalty."""
    rows = lib("recent_frontier_candidate").withColumn("_score", F.col("active_boost") - F.col("recency") + F.col("inbound_boost") - F.col("curated_penalty"))
    return lib.ctx.ranked(rows, "_score", "rank")


@predicate("recent_frontier", "h rank recency", "composition")
def recent_frontier(lib):
    """Ranks up to 50."""
    return lib("recent_frontier_ranked").where("rank <= 50")


@predicate("anchor_status_score", "h score priority why", "composition")
def anchor_status_score(lib):
    """What a file's status counts for."""
    of = lib("lifecycle_status_classification", "status", "required_classification", "origin").drop("origin").distinct()
    policy = within(lib("anchor_status_policy"), of, ["status", "required_classification"])
    return within(lib("status_of"), lib("orientation_file"), "h").join(policy, "status")


def _signal(df, score, priority, why):
    lit = lambda x: x if not isinstance(x, int) else F.lit(x).cast("long")
    return df.select("h", lit(score).cast("long").alias("score"), lit(priority).cast("long").alias("priority"), F.lit(why).alias("why"))


@predicate("anchor_curated_score", "h score priority why", "composition")
def anchor_curated_score(lib):
    """65 for hubs."""
    return _signal(lib("orientation_curated_hub"), 65, 4, "curated_name")


@predicate("anchor_inbound_score", "h score priority why", "composition")
def anchor_inbound_score(lib):
    """50, 35, 25 or 10 by the number of sources."""
    d = F.col("degree")
    step = lambda *values: F.when(d >= 50, values[0]).when(d >= 20, values[1]).when(d >= 10, values[2]).otherwise(values[3])
    return _signal(lib("orientation_inbound_count").where("degree >= 3"), step(50, 35, 25, 10), step(6, 7, 8, 9), "inbound_degree")


@predicate("anchor_recent_score", "h score priority why", "composition")
def anchor_recent_score(lib):
    """8 for dates of the last month, 3 for those of the last year."""
    new = F.col("days") <= 30
    return _signal(lib("recent_frontier_authored_age"), F.when(new, 8).otherwise(3), F.when(new, 10).otherwise(11), "recent")


@predicate("anchor_currency_score", "h score priority why", "composition")
def anchor_currency_score(lib):
    """110 for operative heads of successions."""
    return _signal(within(lib("operative"), lib("currency_current_head"), "h"), 110, 5, "current_head")


@predicate("anchor_signal", "h score priority why", "composition")
def anchor_signal(lib):
    """All of these."""
    return union(*[lib(f"anchor_{kind}_score") for kind in ("status", "curated", "inbound", "recent", "currency")])


@predicate("anchor_eligible", "h", "composition")
def anchor_eligible(lib):
    """Files that are neither retired, superseded nor archived, terminal ones only with a status that counts."""
    rows = union(without(lib("orientation_file").select("h"), lib("terminal"), "h"), lib("anchor_status_score").select("h"))
    for bad in ("orientation_retired_status", "currency_superseded", "orientation_historical_file"):
        rows = without(rows, lib(bad), "h")
    return rows


@predicate("anchor_subject", "h", "composition")
def anchor_subject(lib):
    """Handles with any of these signals."""
    return lib("anchor_signal")


@predicate("anchor_total", "h score", "composition")
def anchor_total(lib):
    """Their sum for eligible files."""
    return within(lib("anchor_signal"), lib("anchor_eligible"), "h").groupBy("h").agg(F.sum("score").alias("score"))


@predicate("anchor_primary_why", "h why", "composition")
def anchor_primary_why(lib):
    """The strongest signal of each."""
    rows = within(lib("anchor_signal"), lib("anchor_total"), "h")
    return top(rows, ["h"], F.col("score") * 100 - F.col("priority"), ["why", "score", "priority"], 1)


@predicate("anchor", "h score why", "composition")
def anchor(lib):
    """Files to start from, with the reason; superseded ones count 1."""
    main = lib("anchor_total").join(lib("anchor_primary_why"), "h")
    old = without(without(lib("currency_superseded"), lib("orientation_retired_status"), "h"), lib("orientation_historical_file"), "h")
    return union(main, old.select("h", F.lit(1).cast("long").alias("score"), F.lit("superseded").alias("why")))


@predicate("ranked_anchor", "h rank score why", "composition")
def ranked_anchor(lib):
    """Anchors by dense rank."""
    return lib.ctx.ranked(lib("anchor"), "score", "rank")
