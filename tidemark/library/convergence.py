"""Unsettled work: signals, their energy, and where the corpus moves."""

from pyspark.sql import functions as F

from .base import Library, counted, predicate, table, top, union, within, without

#: Signals of unsettled work with their weights, in order of precedence.
SIGNALS = {"broken_ref": 4, "undischarged": 5, "stale_dep": 3, "spec_code_drift": 3, "confidence_gap": 3, "freshness_decay": 1, "missing_meta": 1, "orphan_label": 1}
table("potential_weight", "source weight", "convergence", "The weight of each signal.", list(SIGNALS.items()))
table("entropy_priority", "source priority", "convergence", "The precedence of signals of one weight.", [(s, i) for i, s in enumerate(SIGNALS)])


@predicate("entropy", "h source", "convergence")
def entropy(lib: Library):
    """Reasons why a handle looks unsettled."""
    files = within(lib.handles(kind="file").select("h"), lib("active"), "h")
    duties = without(without(lib("obligation"), lib("discharged"), "h"), lib("terminal"), "h")
    labels = without(within(lib.handles(kind="label").select("h"), lib("cite_count").where("n = 0"), "h"), lib("discharged"), "h")
    found = {
        "undischarged": duties,
        "broken_ref": lib("broken_reference").select(F.col("src").alias("h")),
        "stale_dep": lib("stale_reference").select(F.col("src").alias("h")),
        "spec_code_drift": lib("spec_code_drift").select(F.col("src").alias("h")),
        "confidence_gap": lib("confidence_gap").select(F.col("src").alias("h")),
        "freshness_decay": within(files, lib("freshness").where("days > 60"), "h"),
        "missing_meta": without(files, lib.rel("meta", key="status").select(F.col("handle").alias("h")), "h"),
        "orphan_label": labels,
    }
    return union(*[df.select("h", F.lit(s).alias("source")) for s, df in found.items()])


@predicate("potential_subject", "h", "convergence")
def potential_subject(lib):
    """Handles with any signal."""
    return lib("entropy")


def _weighed(lib):
    return lib("entropy").join(lib("potential_weight"), "source")


@predicate("potential", "h energy", "convergence")
def potential(lib):
    """The sum of a handle's signals."""
    return _weighed(lib).groupBy("h").agg(F.sum("weight").alias("energy"))


@predicate("primary_entropy", "h source", "convergence")
def primary_entropy(lib):
    """The strongest signal of each handle."""
    rows = _weighed(lib).join(lib("entropy_priority"), "source")
    return top(rows, ["h"], F.col("weight") * 100 - F.col("priority"), ["source", "weight", "priority"], 1)


def _errors(lib):
    return lib("diagnostic").where("severity = 'error'").join(lib("area_of", "subject", "area"), "subject")


@predicate("area_error_location_count", "area code subject file line count", "structure")
def area_error_location_count(lib):
    """Errors of each area by code, subject and place."""
    return _errors(lib).groupBy("area", "code", "subject", "file", "line").agg(F.count_distinct(F.struct("evidence")).alias("count"))


@predicate("area_error_count", "area errors", "structure")
def area_error_count(lib):
    """Distinct evidence of errors in each area."""
    return counted(lib("area"), ["area"], _errors(lib), "evidence", "errors")


@predicate("area_health", "area grade files errors cross_edges", "structure")
def area_health(lib):
    """A grade by whether an area has errors and edges to others."""
    n = lib("area_file_count").join(lib("area_error_count"), "area").join(lib("area_cross_edges"), "area")
    bad, apart = F.col("errors") > 0, F.col("cross_edges") == 0
    return n.withColumn("grade", F.when(bad & apart, "D").when(bad, "C").when(apart, "B").otherwise("A"))


@predicate("area_frontier", "area h score why", "structure")
def area_frontier(lib):
    """The three most unsettled handles of each area."""
    why = lib("primary_entropy", "h", "why").join(lib("entropy_priority", "why", "priority"), "why")
    rows = lib("area_of").join(lib("potential", "h", "score"), "h").join(why, "h")
    return top(rows, ["area"], F.col("score") * 100 - F.col("priority"), ["h", "score", "why"], 3)


@predicate("blocked", "h", "convergence")
def blocked(lib):
    """Active handles of some energy whose status has not moved for 30 days."""
    still = lib.bound("flux", days=30).where("delta = 0")
    return within(within(lib("potential").where("energy >= 3"), lib("active"), "h"), still, "h")


@predicate("blocker", "h energy source", "convergence")
def blocker(lib):
    """What blocks them."""
    return within(lib("potential"), lib("blocked"), "h").join(lib("entropy"), "h")


def _since(lib):
    """Handles with their status in the last snapshot and now; no rows without history."""
    then = lib.last()
    if then is None:
        return lib.nothing("h string, prior string, current string")
    return then.handles().select("h", F.col("status").alias("prior")).distinct().join(lib.handles().select("h", F.col("status").alias("current")).distinct(), "h")


def _places(lib):
    return _since(lib).join(lib("pipeline_position_for", "prior", "p_prior"), "prior").join(lib("pipeline_position_for", "current", "p_current"), "current")


@predicate("recently_advanced", "h", "convergence")
def recently_advanced(lib):
    """Handles further on in the pipeline than in the last snapshot."""
    return _places(lib).where("p_current > p_prior")


@predicate("advancing", "h", "convergence")
def advancing(lib):
    """Active ones of these."""
    return within(lib("recently_advanced"), lib("active"), "h")


@predicate("holding", "h", "convergence")
def holding(lib):
    """Active, unsettled handles of unchanged status."""
    return within(within(_since(lib).where("prior <=> current"), lib("potential"), "h"), lib("active"), "h")


@predicate("regressed", "h", "convergence")
def regressed(lib):
    """Active handles further back in the pipeline."""
    return within(_places(lib).where("p_current < p_prior"), lib("active"), "h")


@predicate("re_opened", "h", "convergence")
def re_opened(lib):
    """Active handles whose status was terminal by configuration."""
    ended = lib("configured_terminal_status", "prior")
    return within(within(_since(lib), ended, "prior"), lib("active"), "h")


@predicate("drifting", "h", "convergence")
def drifting(lib):
    """Regressed or opened again."""
    return union(lib("regressed"), lib("re_opened"))


@predicate("flow", "h direction", "convergence")
def flow(lib):
    """Where handles move."""
    return union(*[lib(d).withColumn("direction", F.lit(d)) for d in ("advancing", "holding", "drifting")])


@predicate("status_broken", "h", "diagnostic")
def status_broken(lib):
    """Subjects of errors."""
    return lib("diagnostic").where("severity = 'error'").select(F.col("subject").alias("h"))


@predicate("status_drifting_reason", "h why", "convergence")
def status_drifting_reason(lib):
    """One reason of drift for each handle."""
    drift = lib("entropy").where("source = 'spec_code_drift'").select("h")
    reason = lambda df, why: df.select("h", F.lit(why).alias("why"))
    again, back = lib("re_opened"), lib("regressed")
    return union(reason(again, "re_opened"), reason(without(back, again, "h"), "regressed"), reason(without(without(drift, again, "h"), back, "h"), "spec_code_drift"))


@predicate("status_flow", "h", "convergence")
def status_flow(lib):
    """Handles that move, hold or drift."""
    return union(lib("advancing"), lib("holding"), lib("status_drifting_reason").select("h"))


@predicate("status_item", "section h score why", "convergence")
def status_item(lib):
    """One section of the dashboard for each handle."""
    energy, broken, stuck = lib("potential", "h", "score"), lib("status_broken"), lib("blocked")
    drift = lib("entropy").where("source = 'spec_code_drift'")
    reasons = lib("status_drifting_reason")

    def item(df, section, score=None, why=None):
        score = F.col("score") if score is None else F.lit(score).cast("long")
        return df.select(F.lit(section).alias("section"), "h", score.alias("score"), (F.col("why") if why is None else F.lit(why)).alias("why"))

    calm = lambda df: without(without(df, broken, "h"), stuck, "h")
    held = without(without(within(energy, stuck, "h").join(lib("primary_entropy", "h", "why"), "h"), broken, "h"), drift, "h")
    errors = lib("diagnostic").where("severity = 'error'").select(F.col("subject").alias("h"), F.col("code").alias("why")).distinct()
    return union(
        item(without(calm(energy), lib("status_flow"), "h"), "work", why="potential"),
        item(held, "blocked"),
        item(calm(lib("advancing")), "advancing", 0, "recently_advanced"),
        item(calm(within(energy, lib("holding"), "h")), "holding", why="holding"),
        item(calm(reasons), "drifting", 0),
        item(without(within(reasons, drift, "h"), broken, "h"), "drifting", 0),
        item(errors, "broken", 100),
    )


@predicate("frontier", "h energy", "convergence")
def frontier(lib):
    """The 25 handles of greatest energy."""
    return top(lib("potential"), [], F.col("energy"), ["h", "energy"], 25)


@predicate("ranked_work", "h energy rank", "convergence")
def ranked_work(lib):
    """All handles with energy, by dense rank."""
    return lib.ctx.ranked(lib("potential"), "energy", "rank")
