"""Dimensions of analysis, example lifecycles, and what hits are shown with."""

from pyspark.sql import functions as F

from .base import REGISTRY, Library, predicate, table, union, without

#: Dimensions with their questions, oracles and dispositions.
table(
    "axis", "name question oracle disposition", "infrastructure", "The dimensions of analysis.",
    [
        ("relevance", "matches my query?", "text x query ranker", "REPORT"),
        ("currency", "displaced?", "old-to-new file Supersedes edges", "REPORT; marked oracle is gate-able, surface down-ranks and annotates"),
        ("lifecycle", "draft, operative, or retired?", "source status against configured lifecycle lattice", "REPORT / PRE-FLIGHT"),
        ("recency", "authored, changed, or observed when?", "date for authored age, git mtime for lower-authority change recency, snapshots for history", "REPORT; flux is TREND"),
        ("importance", "how central?", "degree, citations, impact, neighborhood", "REPORT"),
        ("convergence", "settling?", "snapshot deltas and unsettled-work evidence", "TREND"),
        ("structure", "organized or connected?", "edge kinds, areas, namespaces, sections, pipeline structure", "REPORT"),
        ("obligations", "owed?", "obligation and discharge facts", "GATE-able through E002"),
        ("topic", "same subject?", "shared citation targets over hub-excluded Cites pairs", "REPORT; never an asserted edge"),
        ("dependency-validity", "still valid to depend on?", "terminal target status against conservative builtin classifications plus per-status project overrides", "PRE-FLIGHT for dead; unknown is suggestion-only"),
    ],
)


@predicate("axis_of", "predicate axis", "infrastructure")
def axis_of(lib: Library):
    """The dimension of each predicate, as it was registered with."""
    return lib.ctx.local(sorted((s.name, s.axis) for s in REGISTRY.values()), "predicate string, axis string")


#: The text of the example lifecycles.
PROFILES = {
    "profile_doc_corpus": """# Document corpus lifecycle
pipeline_position_for("draft", 0).
pipeline_position_for("review", 1).
pipeline_position_for("stable", 2).
terminal(h) := status_of(h, "archived").
active(h) := status_of(h, "draft").
active(h) := status_of(h, "review").
settled(h) := status_of(h, "stable").""",
    "profile_code_corpus": """# Code corpus lifecycle
pipeline_position_for("private", 0).
pipeline_position_for("public", 1).
pipeline_position_for("deprecated", 2).
terminal(h) := *meta{handle: h, key: "code.deprecated", value: "true"}.
active(h) := *meta{handle: h, key: "code.visibility", value: "private"}.
active(h) := *meta{handle: h, key: "code.visibility", value: "public"}.
settled(h) := *meta{handle: h, key: "code.visibility", value: "public"}, not terminal(h).""",
    "profile_issue_corpus": """# Issue corpus lifecycle
pipeline_position_for("open", 0).
pipeline_position_for("blocked", 0).
pipeline_position_for("review", 1).
pipeline_position_for("closed", 2).
terminal(h) := status_of(h, "closed").
active(h) := status_of(h, "open").
active(h) := status_of(h, "blocked").
active(h) := status_of(h, "review").
settled(h) := terminal(h).""",
}
for _name, _text in PROFILES.items():
    table(_name, "text", "infrastructure", "An example lifecycle that a project can copy.", [_text])


@predicate("gitignored_scanned_file", "h file", "structure")
def gitignored_scanned_file(lib):
    """Scanned files that git ignores."""
    found = lib.rel("meta", key="md.scan_git_disposition", value="ignored", source="markdown")
    return found.select(F.col("handle").alias("h"), F.col("handle").alias("file"))


@predicate("hit_currency_disposition_known", "h", "currency")
def hit_currency_disposition_known(lib):
    """Handles with a disposition."""
    return lib("currency_disposition")


@predicate("hit_currency_disposition", "h disposition", "currency")
def hit_currency_disposition(lib):
    """The disposition, unknown where there is none."""
    rest = without(lib.handles().select("h"), lib("hit_currency_disposition_known"), "h")
    return union(lib("currency_disposition"), rest.withColumn("disposition", F.lit("unknown")))
