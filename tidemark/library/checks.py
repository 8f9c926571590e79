"""Consistency checks and the diagnostics made of them."""

from pyspark.sql import functions as F

from .base import NULL, Library, counted, edges, evidence, predicate, table, top, union, within, without

table("builtin_dependency_dead_status", "status", "infrastructure", "Terminal statuses that nothing should depend on.", ["superseded", "retired", "archived", "historical", "deprecated"])
table("builtin_dependency_valid_status", "status", "infrastructure", "Statuses that stay valid to depend on.", ["authoritative", "complete", "decided", "stable", "ratified"])
table("referent_warning_disposition", "disposition", "diagnostic", "Drift of a referent that is worth a warning.", ["referent-gone", "referent-moved-ambiguous"])
table("aspirational_code_status", "status", "lifecycle", "Statuses that claim nothing about present code.", ["plan", "research", "reference", "exploratory"])

#: Front matter keys that look like fields of their own, by the field they stand for.
ALIASES = {
    ("references", "Cites", "forward"): ["references", "refs", "relates", "related", "related-to", "related_to", "pins", "companion-to", "companion_to", "see-also", "see_also", "tracked-by", "tracked_by", "cites"],
    ("depends-on", "DependsOn", "forward"): ["builds-on", "builds_on", "extends", "requires", "dependencies", "depends_on"],
    ("superseded-by", "Supersedes", "forward"): ["superseded_by", "replaced-by", "replaced_by"],
    ("supersedes", "Supersedes", "inverse"): ["replaces", "obsoletes"],
}
table("frontmatter_mapping_alias", "key suggested_field edge_kind direction", "infrastructure", "Keys that could be mapped to a field.", [(k, *field) for field, keys in ALIASES.items() for k in keys])
#: Parts of a key's name that suggest a reference.
FRAGMENTS = ["ref", "link", "cite", "relat", "source", "depend", "require", "supersed", "replace", "extend", "build", "track", "pin", "companion"]
table("frontmatter_reference_name_fragment", "fragment", "infrastructure", "Parts of a key's name that suggest a reference.", FRAGMENTS)


def configured(name: str, key: str, axis: str, doc: str) -> None:
    def build(lib: Library):
        return lib.rel("config", key=key).select(F.col("value").alias("status"))

    build.__doc__ = doc
    predicate(name, "status", axis)(build)


configured("configured_dependency_dead_status", "dependency.dead", "infrastructure", "Statuses configured as dead.")
configured("configured_dependency_valid_status", "dependency.valid", "infrastructure", "Statuses configured as valid.")
configured("configured_active_status", "convergence.active", "infrastructure", "Statuses configured as active.")
configured("configured_terminal_status", "convergence.terminal", "infrastructure", "Statuses configured as terminal.")
configured("configured_asserts_code_status", "convergence.asserts_code", "infrastructure", "Statuses configured to make claims about code.")


# References


@predicate("section_ref", "target", "structure")
def section_ref(lib):
    """Targets that are sections."""
    return edges(lib, dst="target").where(F.col("target").startswith("section:"))


@predicate("broken_reference", "src target file line", "diagnostic")
def broken_reference(lib):
    """Edges to no handle, sections aside."""
    e = edges(lib, dst="target").where(~F.col("target").startswith("section:"))
    return without(e, lib.handles().withColumnRenamed("h", "target"), "target")


@predicate("section_ref_edge", "edge_id", "structure")
def section_ref_edge(lib):
    """Edges to sections."""
    return edges(lib).where(F.col("dst").startswith("section:")).select(F.col("native_id").alias("edge_id"))


@predicate("section_ref_total", "count", "structure")
def section_ref_total(lib):
    """Their number, if there are any."""
    return lib("section_ref_edge").agg(F.count("*").alias("count")).where("count > 0")


@predicate("implausible_ref", "h file value", "diagnostic")
def implausible_ref(lib):
    """Links that extraction rejected."""
    found = lib.rel("meta", key="md.implausible_ref").select(F.col("handle").alias("h"), "value")
    return found.join(lib.handles().select("h", "file"), "h")


def _ends(lib: Library, kind: str):
    """Edges of a kind with the status of both ends and the file of the source."""
    e = edges(lib, kind, "src", "target").select("src", "target")
    source = lib.handles().select(F.col("h").alias("src"), F.col("status").alias("source_status"), "file")
    target = lib.handles().select(F.col("h").alias("target"), F.col("status").alias("target_status"))
    return e.join(source, "src").join(target, "target")


@predicate("stale_reference", "src target file source_status target_status", "diagnostic")
def stale_reference(lib):
    """Active handles that depend on a dead one."""
    ends = _ends(lib, "DependsOn").where("source_status is not null")
    ends = within(ends, lib("dependency_dead_status", "target_status"), "target_status")
    return within(within(ends, lib("terminal", "target"), "target"), lib("active", "src"), "src")


@predicate("configured_dependency_status", "status", "infrastructure")
def configured_dependency_status(lib):
    """Statuses with a configured validity."""
    return union(lib("configured_dependency_dead_status"), lib("configured_dependency_valid_status"))


@predicate("dependency_status_classification", "status classification origin", "dependency-validity")
def dependency_status_classification(lib):
    """Which statuses are dead or valid to depend on; what is configured hides what is built in."""
    own = lib("configured_dependency_status")
    mark = lambda df, c, o: df.select("status", F.lit(c).alias("classification"), F.lit(o).alias("origin"))
    parts = []
    for c in ("dead", "valid"):
        parts.append(mark(lib(f"configured_dependency_{c}_status"), c, "project"))
        parts.append(mark(without(lib(f"builtin_dependency_{c}_status"), own, "status"), c, "builtin"))
    return union(*parts)


@predicate("dependency_dead_status", "status", "dependency-validity")
def dependency_dead_status(lib):
    """Statuses that are dead to depend on."""
    return lib("dependency_status_classification").where("classification = 'dead'")


@predicate("dependency_valid_status", "status", "dependency-validity")
def dependency_valid_status(lib):
    """Statuses that are valid to depend on."""
    return lib("dependency_status_classification").where("classification = 'valid'")


# Code references


def _meta(lib: Library, key: str, name: str, value: str | None = None):
    df = lib.rel("meta", key=key).select(F.col("handle").alias("ref"), F.col("value").alias(name))
    return df if value is None else df.where(F.col(name) == value).select("ref")


@predicate("referent_disposition", "target disposition", "currency")
def referent_disposition(lib):
    """What became of a cited target."""
    return _meta(lib, "code.referent_disposition", "disposition").withColumnRenamed("ref", "target")


@predicate("referent_drift_evidence_present", "ref", "infrastructure")
def referent_drift_evidence_present(lib):
    """Targets of which that is known."""
    return lib("referent_disposition", "ref", "disposition")


@predicate("spec_code_drift", "src target_path file line source_status", "diagnostic")
def spec_code_drift(lib):
    """Files that make claims about code which is missing, gone or moved."""
    cites = edges(lib, "Cites", "src", "ref").select("src", "ref", "file", "line")
    files = lib.handles(kind="file").select(F.col("h").alias("src"), F.col("status").alias("source_status"))
    files = within(files, lib("asserts_code", "source_status"), "source_status")
    external = within(lib.handles(kind="external").select(F.col("h").alias("ref")), _meta(lib, "external_class", "c", "code"), "ref")
    cited = within(cites.join(files, "src"), external, "ref").join(_meta(lib, "target_path", "target_path"), "ref")
    missing = without(within(cited, _meta(lib, "target_exists", "e", "false"), "ref"), lib("referent_drift_evidence_present"), "ref")
    bad = within(lib("referent_disposition", "ref", "disposition"), lib("referent_warning_disposition"), "disposition")
    return union(missing, within(cited, bad, "ref"))


@predicate("assertion_drift", "spec target commits", "currency")
def assertion_drift(lib):
    """Commits to a cited target since the claim was made."""
    since = _meta(lib, "code.referent_commits_since", "commits").withColumnRenamed("ref", "target")
    return edges(lib, "Cites", "spec", "target").select("spec", "target").join(since, "target")


@predicate("referent_moved_head", "target new_path", "currency")
def referent_moved_head(lib):
    """Where a target has moved."""
    return _meta(lib, "code.referent_moved_to", "new_path").withColumnRenamed("ref", "target")


@predicate("drift_profile", "bucket count", "currency")
def drift_profile(lib):
    """Targets by disposition."""
    return lib("referent_disposition", "target", "bucket").groupBy("bucket").agg(F.count_distinct("target").alias("count"))


@predicate("path_resolves", "ref path file", "infrastructure")
def path_resolves(lib):
    """Code paths that are, or resolve to a path ending with, a code file."""
    files = lib.rel("handle", kind="file", source="code").select("file").distinct()
    paths = _meta(lib, "target_path", "path")
    exact = within(paths, _meta(lib, "external_class", "c", "code"), "ref").join(files, F.col("path") == F.col("file"))
    # A file can only end the path if its last component is the path's.
    last = lambda c: F.substring_index(c, "/", -1)
    whole = paths.join(_meta(lib, "target_resolved_path", "resolved"), "ref").withColumn("last", last("resolved"))
    tails = whole.join(files.withColumn("last", last("file")), "last").where(F.endswith("resolved", "file"))
    return union(exact.select("ref", "path", "file"), tails)


@predicate("code_ref", "spec ref path code_handle disposition", "composition")
def code_ref(lib):
    """Citations of code with the code file's handle and what became of it."""
    cites = edges(lib, "Cites", "spec", "ref").where("source = 'markdown'").select("spec", "ref")
    external = within(lib.rel("handle", kind="external", source="markdown").select(F.col("id").alias("ref")), _meta(lib, "external_class", "c", "code"), "ref")
    code = lib.rel("handle", kind="file", source="code").select(F.col("id").alias("code_handle"), "file")
    return within(cites, external, "ref").join(lib("path_resolves"), "ref").join(code, "file").join(lib("referent_disposition", "ref", "disposition"), "ref")


# Lifecycle configuration


@predicate("configured_pipeline_status", "status level", "infrastructure")
def configured_pipeline_status(lib):
    """The configured pipeline."""
    return lib.rel("config", key="convergence.ordering").where("ordinal is not null").select(F.col("value").alias("status"), F.col("ordinal").alias("level"))


@predicate("configured_asserts_code_present", "answer", "infrastructure")
def configured_asserts_code_present(lib):
    """`yes` if statuses that make claims about code are configured."""
    return lib("configured_asserts_code_status").limit(1).select(F.lit("yes").alias("answer"))


@predicate("asserts_code", "status", "lifecycle")
def asserts_code(lib):
    """Statuses that make claims about present code: those configured, else the active ones in use."""
    own = lib("configured_asserts_code_status")
    used = within(lib.handles().where("status is not null"), lib("active"), "h").select("status")
    usual = without(used, lib("aspirational_code_status"), "status")
    return union(own, usual.join(own.limit(1).select(F.lit(1)), F.lit(True), "left_anti"))


@predicate("configured_lifecycle_status", "status", "infrastructure")
def configured_lifecycle_status(lib):
    """Statuses configured as active, settled or terminal."""
    return lib.rel("config").where("key in ('convergence.active', 'convergence.settled', 'convergence.terminal')").select(F.col("value").alias("status"))


@predicate("modeled_lifecycle_status", "status", "lifecycle")
def modeled_lifecycle_status(lib):
    """Statuses with a class."""
    return lib("lifecycle_status_classification")


@predicate("modeled_terminal_status", "status", "lifecycle")
def modeled_terminal_status(lib):
    """Statuses of the class terminal."""
    return lib("lifecycle_status_classification").where("classification = 'terminal'")


@predicate("used_lifecycle_status", "status", "infrastructure")
def used_lifecycle_status(lib):
    """Statuses in use."""
    return lib.handles().where("status is not null")


@predicate("lifecycle_status_candidate", "status", "lifecycle")
def lifecycle_status_candidate(lib):
    """Statuses in use or in the configured pipeline."""
    return union(lib("used_lifecycle_status"), lib("configured_pipeline_status"))


@predicate("status_handle_count", "status count", "convergence")
def status_handle_count(lib):
    """Handles of each of these."""
    return counted(lib("lifecycle_status_candidate"), ["status"], lib.handles().where("status is not null"), "h", "count")


@predicate("max_pipeline_level", "level", "structure")
def max_pipeline_level(lib):
    """The last place of the configured pipeline."""
    return lib("configured_pipeline_status").agg(F.max("level").alias("level")).where("level is not null")


@predicate("max_pipeline_status", "status", "structure")
def max_pipeline_status(lib):
    """The status there."""
    return within(lib("configured_pipeline_status"), lib("max_pipeline_level"), "level")


@predicate("lifecycle_config_gap", "status count variant", "diagnostic")
def lifecycle_config_gap(lib):
    """Statuses in use or ordered without a class, and pipelines that don't end."""
    n = lib("status_handle_count")
    gap = lambda df, known, why: without(df.select("status").distinct().join(n, "status"), lib(known), "status").withColumn("variant", F.lit(why))
    return union(
        gap(lib("used_lifecycle_status"), "modeled_lifecycle_status", "used_status_unpartitioned"),
        gap(lib("configured_pipeline_status"), "modeled_lifecycle_status", "ordering_status_unpartitioned"),
        gap(lib("max_pipeline_status"), "modeled_terminal_status", "ordering_not_terminal"),
    )


# Front matter


@predicate("configured_frontmatter_alias", "key", "infrastructure")
def configured_frontmatter_alias(lib):
    """Alias keys that the configuration maps."""
    name = F.regexp_extract("key", r"^frontmatter\.field\.(.+)\.edge_kind$", 1)
    mapped = lib.rel("config").select(name.alias("key")).where("key <> ''")
    return within(mapped, lib("frontmatter_mapping_alias"), "key")


@predicate("frontmatter_mapping_alias_key", "key", "infrastructure")
def frontmatter_mapping_alias_key(lib):
    """All alias keys."""
    return lib("frontmatter_mapping_alias")


@predicate("frontmatter_unmapped_alias_use", "key h", "diagnostic")
def frontmatter_unmapped_alias_use(lib):
    """Handles that use an alias key which nothing maps."""
    used = lib.rel("meta", role="authored_unmodeled").select("key", F.col("handle").alias("h"))
    used = within(used, lib("frontmatter_mapping_alias_key"), "key")
    used = within(used, lib.rel("meta", key="md.parent_dir").select(F.col("handle").alias("h")), "h")
    return without(used, lib("configured_frontmatter_alias"), "key")


@predicate("frontmatter_mapping_gap", "key distinct_handle_count suggested_field edge_kind direction", "diagnostic")
def frontmatter_mapping_gap(lib):
    """Such keys with the number of their handles and what they could be mapped to."""
    n = lib("frontmatter_unmapped_alias_use").groupBy("key").agg(F.count_distinct("h").alias("distinct_handle_count"))
    return lib("frontmatter_mapping_alias").join(n, "key")


@predicate("unmodeled_frontmatter_key_use", "key h", "infrastructure")
def unmodeled_frontmatter_key_use(lib):
    """Files that use a key of their own which is no alias."""
    used = lib.rel("meta", role="authored_unmodeled", source="markdown").select("key", F.col("handle").alias("h"))
    return without(within(used, lib.handles(kind="file"), "h"), lib("frontmatter_mapping_alias_key"), "key")


@predicate("unmodeled_frontmatter_key_present", "key", "infrastructure")
def unmodeled_frontmatter_key_present(lib):
    """Those keys."""
    return lib("unmodeled_frontmatter_key_use")


@predicate("frontmatter_reference_name_signal", "key", "infrastructure")
def frontmatter_reference_name_signal(lib):
    """Those whose name suggests a reference."""
    return lib("unmodeled_frontmatter_key_present").join(lib("frontmatter_reference_name_fragment"), F.contains("key", "fragment"))


@predicate("unmodeled_frontmatter_key_signal", "key reference_name_signal", "infrastructure")
def unmodeled_frontmatter_key_signal(lib):
    """1 for those, 0 for the others."""
    yes = lib("frontmatter_reference_name_signal").withColumn("reference_name_signal", F.lit(1).cast("long"))
    return lib("unmodeled_frontmatter_key_present").join(yes, "key", "left").withColumn("reference_name_signal", F.coalesce("reference_name_signal", F.lit(0).cast("long")))


@predicate("unmodeled_frontmatter_rank_weight", "key unit weight", "infrastructure")
def unmodeled_frontmatter_rank_weight(lib):
    """2 for each file that uses a key, 1 for a name that suggests a reference."""
    files = lib("unmodeled_frontmatter_key_use", "key", "unit").withColumn("weight", F.lit(2).cast("long"))
    return union(files, lib("frontmatter_reference_name_signal").select("key", F.col("key").alias("unit"), F.lit(1).cast("long").alias("weight")))


@predicate("unmodeled_frontmatter_key", "key distinct_file_handles reference_name_signal rank", "infrastructure")
def unmodeled_frontmatter_key(lib):
    """Keys with their files, signal and rank."""
    n = lib("unmodeled_frontmatter_key_use").groupBy("key").agg(F.count_distinct("h").alias("distinct_file_handles"))
    rank = lib("unmodeled_frontmatter_rank_weight").groupBy("key").agg(F.sum("weight").alias("rank"))
    return n.join(lib("unmodeled_frontmatter_key_signal"), "key").join(rank, "key")


# Dependencies and obligations


@predicate("terminal_status_used", "status", "infrastructure")
def terminal_status_used(lib):
    """Statuses of terminal handles."""
    return within(lib.handles().where("status is not null"), lib("terminal"), "h")


@predicate("terminal_status_handle_count", "status count", "infrastructure")
def terminal_status_handle_count(lib):
    """Terminal handles of each."""
    return within(lib.handles().where("status is not null"), lib("terminal"), "h").groupBy("status").agg(F.count_distinct("h").alias("count"))


@predicate("dependency_config_gap", "status count variant", "diagnostic")
def dependency_config_gap(lib):
    """Those that are neither dead nor valid to depend on."""
    n = without(lib("terminal_status_handle_count"), lib("dependency_dead_status"), "status")
    return without(n, lib("dependency_valid_status"), "status").withColumn("variant", F.lit("terminal_status_unclassified"))


@predicate("confidence_gap", "src target file source_status source_level target_status target_level", "convergence")
def confidence_gap(lib):
    """Handles that depend on one more than a step behind them in the pipeline."""
    ends = _ends(lib, "DependsOn").join(lib("pipeline_position", "src", "source_level"), "src").join(lib("pipeline_position", "target", "target_level"), "target")
    return ends.where("source_level > target_level + 1")


def _duties(lib):
    return without(lib("obligation"), lib("terminal"), "h").join(lib("discharge_count", "h", "count"), "h").join(lib("handle_file"), "h")


@predicate("undischarged_obligation", "h file", "obligations")
def undischarged_obligation(lib):
    """Open obligations that nothing discharges."""
    return _duties(lib).where("count = 0")


@predicate("multiple_discharge", "h file count", "obligations")
def multiple_discharge(lib):
    """Obligations discharged twice or more."""
    return _duties(lib).where("count >= 2")


# Adoption of front matter, orphans


@predicate("file_parent_dir", "h dir", "structure")
def file_parent_dir(lib):
    """Directories of files."""
    dirs = lib.rel("meta", key="md.parent_dir").select(F.col("handle").alias("h"), F.col("value").alias("dir"))
    return within(dirs, lib.handles(kind="file"), "h")


@predicate("parent_dir_present", "dir", "structure")
def parent_dir_present(lib):
    """All directories."""
    return lib("file_parent_dir")


@predicate("parent_dir_file_count", "dir total", "structure")
def parent_dir_file_count(lib):
    """Files of each directory of two or more."""
    return lib("file_parent_dir").groupBy("dir").agg(F.count_distinct("h").alias("total")).where("total >= 2")


@predicate("parent_dir_frontmatter_count", "dir with_frontmatter", "structure")
def parent_dir_frontmatter_count(lib):
    """Files with a status in each directory."""
    with_status = within(lib("file_parent_dir"), lib.handles().where("status is not null"), "h")
    return counted(lib("parent_dir_present"), ["dir"], with_status, "h", "with_frontmatter")


@predicate("frontmatter_adoption_high", "dir with_frontmatter total", "lifecycle")
def frontmatter_adoption_high(lib):
    """Directories where more than half of the files have a status."""
    return lib("parent_dir_file_count").join(lib("parent_dir_frontmatter_count"), "dir").where("with_frontmatter * 2 > total")


@predicate("missing_frontmatter_file", "h dir file", "diagnostic")
def missing_frontmatter_file(lib):
    """Files without a status there."""
    bare = lib.handles(kind="file").where("status is null").select("h", "file")
    return within(bare.join(lib("file_parent_dir"), "h"), lib("frontmatter_adoption_high"), "dir")


@predicate("orphaned_handle", "h", "diagnostic")
def orphaned_handle(lib):
    """Labels that nothing points to, and versions that supersede another and nothing points to."""
    alone = lib("in_degree").where("n = 0")
    versions = within(lib.handles(kind="version"), edges(lib, "Supersedes", "h"), "h")
    return within(union(lib.handles(kind="label").select("h"), versions), alone, "h")


# Pipelines and namespaces over time


@predicate("next_pipeline_status", "status next_status", "structure")
def next_pipeline_status(lib):
    """The status one place on."""
    p = lib("configured_pipeline_status")
    return p.withColumn("level", F.col("level") + 1).join(p.toDF("next_status", "level"), "level")


@predicate("status_population", "status count", "convergence")
def status_population(lib):
    """Handles of each configured status."""
    return within(lib("status_handle_count"), lib("configured_pipeline_status"), "status")


@predicate("forward_dependency_to_next_status", "status next_status", "structure")
def forward_dependency_to_next_status(lib):
    """Statuses of which one depends on the other."""
    return _ends(lib, "DependsOn").select(F.col("source_status").alias("status"), F.col("target_status").alias("next_status"))


@predicate("snapshot_history_present", "count", "recency")
def snapshot_history_present(lib):
    """The number of snapshots, if there are any."""
    return lib.rel("snapshot").agg(F.count_distinct("snapshot").alias("count")).where("count > 0")


@predicate("snapshot_history_exists", "answer", "recency")
def snapshot_history_exists(lib):
    """`yes` if there are snapshots."""
    return lib("snapshot_history_present").select(F.lit("yes").alias("answer"))


@predicate("previous_status_population", "status count", "convergence")
def previous_status_population(lib):
    """Handles of each configured status in the last snapshot."""
    then = lib.last()
    if then is None:
        return lib.nothing("status string, count long")
    return counted(lib("configured_pipeline_status"), ["status"], then.handles().where("status is not null"), "h", "count")


@predicate("s003_pipeline_stall", "status count next_status based_on_history", "diagnostic")
def s003_pipeline_stall(lib):
    """Statuses of three handles or more that have not become fewer, with a next one to move to."""
    before = lib("previous_status_population", "status", "previous")
    both = lib("status_population").join(before, "status").where("count >= previous and previous >= 3")
    return both.join(lib("next_pipeline_status"), "status").withColumn("based_on_history", F.lit(True))


@predicate("pipeline_stall", "status count next_status based_on_history", "diagnostic")
def pipeline_stall(lib):
    """Stalled statuses."""
    return lib("s003_pipeline_stall")


@predicate("abandoned_terminal_member", "namespace h", "diagnostic")
def abandoned_terminal_member(lib):
    """Terminal labels of active namespaces."""
    return within(lib("active_namespace_member"), lib("terminal"), "h")


@predicate("abandoned_stale_member", "namespace h", "diagnostic")
def abandoned_stale_member(lib):
    """Others that are 90 days old or more."""
    return within(without(lib("active_namespace_member"), lib("terminal"), "h"), lib("freshness").where("days >= 90"), "h")


@predicate("abandoned_terminal_count", "namespace count", "diagnostic")
def abandoned_terminal_count(lib):
    """Terminal members of each active namespace."""
    return counted(lib("active_namespace"), ["namespace"], lib("abandoned_terminal_member"), "h", "count")


@predicate("abandoned_stale_count", "namespace count", "diagnostic")
def abandoned_stale_count(lib):
    """Stale members of each active namespace."""
    return counted(lib("active_namespace"), ["namespace"], lib("abandoned_stale_member"), "h", "count")


@predicate("s004_abandoned_namespace", "namespace total terminal_count stale_count", "diagnostic")
def s004_abandoned_namespace(lib):
    """Namespaces of which all members are terminal or stale."""
    n = lib("active_namespace_size").join(lib("abandoned_terminal_count", "namespace", "terminal_count"), "namespace").join(lib("abandoned_stale_count", "namespace", "stale_count"), "namespace")
    return n.where("terminal_count + stale_count = total")


@predicate("abandoned_namespace", "namespace total terminal_count stale_count", "diagnostic")
def abandoned_namespace(lib):
    """Abandoned namespaces."""
    return lib("s004_abandoned_namespace")


@predicate("s005_pair_count", "left_prefix right_prefix count", "diagnostic")
def s005_pair_count(lib):
    """Namespaces that three files or more use together and that share no concern."""
    used = within(lib("file_prefix").withColumnRenamed("prefix", "namespace"), lib("active_namespace"), "namespace").select("file", "namespace")
    both = used.toDF("file", "left_prefix").join(used.toDF("file", "right_prefix"), "file").where("left_prefix < right_prefix")
    n = both.groupBy("left_prefix", "right_prefix").agg(F.count_distinct("file").alias("count")).where("count >= 3")
    return without(n, lib("same_concern_pair"), ["left_prefix", "right_prefix"])


@predicate("s005_top_pair", "left_prefix right_prefix count", "diagnostic")
def s005_top_pair(lib):
    """The five most frequent such pairs."""
    return top(lib("s005_pair_count"), [], F.col("count"), ["left_prefix", "right_prefix", "count"], 5)


@predicate("top_pair", "left_prefix right_prefix count", "structure")
def top_pair(lib):
    """The five most frequent such pairs."""
    return lib("s005_top_pair")


# Diagnostics

_COLUMNS = "code severity subject file line evidence"


def finding(df, code: str, severity: str, subject: str, proof, file=None, line=None):
    """Rows of one code. Without a file or line these are null."""
    where = F.col(file).alias("file") if file else NULL("file")
    at = F.col(line).alias("line") if line else NULL("line", "long")
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(subject).alias("subject"), where, at, proof.alias("evidence"))


@predicate("diagnostic", _COLUMNS, "diagnostic", protected=True)
def diagnostic(lib):
    """All findings: code, severity, subject, file, line and evidence, a JSON text."""
    corpus = lib("section_ref_total").withColumn("subject", F.lit("corpus"))
    orphans = lib("orphaned_handle").join(lib.handles().select("h", "kind"), "h").join(lib("handle_file"), "h")
    abandoned = lib("abandoned_namespace").join(lib("active_namespace_representative_file"), "namespace")
    return union(
        finding(lib("broken_reference"), "E001", "error", "src", evidence("broken_ref", "target"), "file", "line"),
        finding(lib("undischarged_obligation"), "E002", "error", "h", F.lit('"undischarged"'), "file"),
        finding(lib("stale_reference"), "W001", "warning", "src", evidence("stale_ref", "source_status", "target_status"), "file"),
        finding(lib("confidence_gap"), "W002", "warning", "src", evidence("confidence_gap", "source_status", "source_level", "target_status", "target_level"), "file"),
        finding(lib("missing_frontmatter_file"), "W003", "warning", "h", F.lit(None).cast("string"), "file"),
        finding(lib("implausible_ref"), "W004", "warning", "h", evidence("implausible_ref", "value"), "file"),
        finding(lib("lifecycle_config_gap"), "W005", "warning", "status", evidence("lifecycle_config_gap", "status", "count", "variant")),
        finding(lib("spec_code_drift"), "W006", "warning", "src", evidence("spec_code_drift", "target_path", "source_status"), "file", "line"),
        finding(lib("frontmatter_mapping_gap"), "W007", "warning", "key", evidence("frontmatter_mapping_gap", "key", "distinct_handle_count", "suggested_field", "edge_kind", "direction")),
        finding(corpus, "I001", "info", "subject", evidence("section_refs", "count")),
        finding(lib("multiple_discharge"), "I002", "info", "h", evidence("multiple_discharges", "count"), "file"),
        finding(orphans, "S001", "suggestion", "h", evidence("orphaned_handle", "kind", "h"), "file"),
        finding(lib("pipeline_stall"), "S003", "suggestion", "status", evidence("pipeline_stall", "status", "count", "next_status", "based_on_history")),
        finding(abandoned, "S004", "suggestion", "namespace", evidence("abandoned_namespace", "namespace", "total", "terminal_count", "stale_count"), "file"),
        finding(lib("top_pair"), "S005", "suggestion", "left_prefix", evidence("concern_group_candidate", "left_prefix", "right_prefix", "count")),
        finding(lib("dependency_config_gap"), "S006", "suggestion", "status", evidence("dependency_config_gap", "status", "count", "variant")),
    )
