"""Files about the same subject, by shared citations."""

from pyspark.sql import functions as F

from .base import Library, counted, edges, predicate, table, union, within, without

table("topic_mega_target_cap", "most", "topic", "Targets cited by more files than this tell nothing.", [40])


def _citations(lib: Library):
    """(f, t): files that cite."""
    return within(edges(lib, "Cites", "f", "t").select("f", "t").distinct(), lib.handles(kind="file").withColumnRenamed("h", "f"), "f")


@predicate("topic_citation_target", "t", "topic")
def topic_citation_target(lib):
    """Files and labels cited by files."""
    targets = lib.handles().where("kind in ('file', 'label')").withColumnRenamed("h", "t")
    return within(_citations(lib), targets, "t")


@predicate("topic_target_citation_count", "t n", "topic")
def topic_target_citation_count(lib):
    """Citing files of each."""
    return counted(lib("topic_citation_target"), ["t"], _citations(lib), "f", "n")


@predicate("topic_nondiscriminative_target", "t", "topic")
def topic_nondiscriminative_target(lib):
    """Hubs and targets that too many files cite."""
    many = lib("topic_target_citation_count").join(lib("topic_mega_target_cap"), F.col("n") > F.col("most"))
    return union(lib("orientation_curated_hub", "t"), many.select("t"))


@predicate("topic_shared_target", "left right t", "topic")
def topic_shared_target(lib):
    """Pairs of files that cite one telling target; the cap on citing files bounds the pairs of each target."""
    cites = within(_citations(lib), lib("topic_citation_target"), "t")
    cites = without(without(cites, lib("topic_nondiscriminative_target"), "t"), lib("orientation_curated_hub", "f"), "f")
    # Written, so that pairs are made of one narrow table in a stage of their own.
    cites = lib.ctx.shared(cites.select("t", "f"))
    left, right = cites.select("t", F.col("f").alias("left")), cites.select("t", F.col("f").alias("right"))
    return left.join(right, "t").where(F.col("left") < F.col("right"))


@predicate("topic_pair", "left right shared", "topic")
def topic_pair(lib):
    """Pairs with two such targets or more."""
    return lib("topic_shared_target").groupBy("left", "right").agg(F.count_distinct("t").alias("shared")).where("shared >= 2")


@predicate("topic_sibling", "a b shared", "topic")
def topic_sibling(lib):
    """Either way round."""
    p = lib("topic_pair")
    return p.toDF("a", "b", "shared").union(p.select("right", "left", "shared"))


@predicate("currency_suspect", "stale newer", "composition")
def currency_suspect(lib):
    """Files with a newer, operative sibling, neither superseded."""
    rows = lib("topic_sibling", "stale", "newer", "shared").join(lib("authored_age", "stale", "stale_age"), "stale").join(lib("authored_age", "newer", "newer_age"), "newer").where("newer_age < stale_age")
    rows = within(rows, lib("operative", "newer"), "newer")
    return without(without(rows, lib("currency_superseded", "newer"), "newer"), lib("currency_superseded", "stale"), "stale")
