"""Areas, namespaces, degrees and neighbours."""

from pyspark.sql import functions as F

from .base import Library, counted, edges, predicate, union, within, without


@predicate("area_of", "h area", "structure")
def area_of(lib: Library):
    """The area of each handle that has one."""
    return lib.handles().where("area <> ''")


@predicate("namespace_of", "h namespace", "structure")
def namespace_of(lib):
    """The namespace of each handle that has one."""
    return lib.handles().where("namespace <> ''")


@predicate("status_of", "h status", "lifecycle")
def status_of(lib):
    """The status of each handle that has one."""
    return lib.handles().where("status is not null")


@predicate("incoming_edge", "h from kind", "importance")
def incoming_edge(lib):
    """Edges seen from their targets."""
    return lib.rel("edge").withColumnRenamed("to", "h")


@predicate("outgoing_edge", "h to kind", "importance")
def outgoing_edge(lib):
    """Edges seen from their sources."""
    return lib.rel("edge").withColumnRenamed("from", "h")


@predicate("incident", "h other", "structure")
def incident(lib):
    """Neighbours in either direction."""
    e = edges(lib)
    return e.select(F.col("src").alias("h"), F.col("dst").alias("other")).union(e.select("dst", "src"))


@predicate("orphan", "h", "structure")
def orphan(lib):
    """Handles, files and sections aside, that nothing points to."""
    alone = lib("in_degree").where("n = 0")
    return within(lib.handles().where("not kind <=> 'file' and not kind <=> 'section'"), alone, "h")


@predicate("stub", "h", "diagnostic")
def stub(lib):
    """Files without content."""
    return within(lib.handles(kind="file"), lib("token_estimate").where("n = 0"), "h")


@predicate("hub", "h degree", "importance")
def hub(lib):
    """Handles with ten distinct neighbours or more."""
    return counted(lib.handles(), ["h"], lib("incident"), "other", "degree").where("degree >= 10")


@predicate("area", "area", "structure")
def area(lib):
    """All areas."""
    return lib("area_of")


@predicate("area_file_count", "area files", "structure")
def area_file_count(lib):
    """Files of each area."""
    return counted(lib("area"), ["area"], lib.handles(kind="file"), "h", "files")


@predicate("area_cross_edges", "area cross_edges", "structure")
def area_cross_edges(lib):
    """Distinct targets in other areas of each area's edges."""
    src, dst = lib("area_of", "src", "area"), lib("area_of", "dst", "other")
    away = edges(lib).select("src", "dst").join(src, "src").join(dst, "dst").where("area <> other")
    return counted(lib("area"), ["area"], away, "dst", "cross_edges")


@predicate("handle_file", "h file", "structure")
def handle_file(lib):
    """Where a handle stands: its own file, and the one its reference was resolved to."""
    own = lib.handles().where("file <> ''").select("h", "file")
    found = lib.rel("meta", key="md.resolved_file").select(F.col("handle").alias("h"), F.col("value").alias("file"))
    return union(own, found)


@predicate("rejected_namespace", "namespace", "structure")
def rejected_namespace(lib):
    """Namespaces that the configuration rejects."""
    return lib.rel("config", key="handles.rejected").select(F.col("value").alias("namespace"))


@predicate("namespace_label", "namespace h", "structure")
def namespace_label(lib):
    """Labels by namespace."""
    return lib.handles(kind="label").where("namespace <> ''")


@predicate("namespace_present", "namespace", "structure")
def namespace_present(lib):
    """Namespaces with labels."""
    return lib("namespace_label")


@predicate("namespace_label_count", "namespace count", "structure")
def namespace_label_count(lib):
    """Labels of each namespace."""
    return counted(lib("namespace_present"), ["namespace"], lib("namespace_label"), "h", "count")


@predicate("active_namespace", "namespace", "structure")
def active_namespace(lib):
    """Namespaces with labels that are not rejected."""
    return without(lib("namespace_present"), lib("rejected_namespace"), "namespace")


@predicate("active_namespace_member", "namespace h", "structure")
def active_namespace_member(lib):
    """Labels of those namespaces."""
    return within(lib("namespace_label"), lib("active_namespace"), "namespace")


@predicate("active_namespace_size", "namespace total", "structure")
def active_namespace_size(lib):
    """Members of each such namespace, if two or more."""
    return counted(lib("active_namespace"), ["namespace"], lib("active_namespace_member"), "h", "total").where("total >= 2")


@predicate("active_namespace_representative_file", "namespace file", "structure")
def active_namespace_representative_file(lib):
    """The smallest file of the members of each namespace of two or more."""
    members = within(lib("active_namespace_member"), lib("active_namespace_size"), "namespace")
    return members.join(lib("handle_file"), "h").groupBy("namespace").agg(F.min("file").alias("file"))


@predicate("file_prefix", "file prefix", "structure")
def file_prefix(lib):
    """Namespaces whose labels a file cites or depends on."""
    used = edges(lib, src="file_id").where("kind in ('Cites', 'DependsOn')").select(F.col("file_id").alias("h"), F.col("dst"))
    from_files = within(used, lib.handles(kind="file"), "h")
    return from_files.join(lib("namespace_label", "prefix", "dst"), "dst").select(F.col("h").alias("file"), "prefix")


def ordered_pairs(names):
    """All (left_prefix, right_prefix) with left before right, of a few names."""
    left, right = names.toDF("left_prefix"), names.toDF("right_prefix")
    return left.join(right, F.col("left_prefix") < F.col("right_prefix"))


@predicate("same_concern_pair", "left_prefix right_prefix", "structure")
def same_concern_pair(lib):
    """Namespaces with labels in one concern."""
    labels = lib.handles(kind="label").select("h", "namespace")
    of = lib.rel("concern").select("name", F.col("member").alias("h")).join(labels, "h").select("name", "namespace").distinct()
    left, right = of.toDF("name", "left_prefix"), of.toDF("name", "right_prefix")
    return left.join(right, "name").where("left_prefix < right_prefix")


@predicate("prefix_pair_candidate", "left_prefix right_prefix", "structure")
def prefix_pair_candidate(lib):
    """Ordered pairs of active namespaces."""
    return ordered_pairs(lib("active_namespace"))
