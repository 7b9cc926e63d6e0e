"""Queries for the operators of this subpackage; each takes (spark, folder) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.queries import Query, table
from ..session import cut
from . import copies, cuts, leaks, linking, packing, survivors

_ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


@query
def p3_found(spark, d):
    pairs = table(spark, d, "match_pairs").filter("lower(verdict) = 'match'")
    return linking.linked_groups(pairs, "row_a", "row_b")


@query
def p3_distributed(spark, d):
    """The same groups with no step left to a single task, however small the graph."""
    pairs = table(spark, d, "match_pairs").filter("lower(verdict) = 'match'")
    return linking.linked_groups(pairs, "row_a", "row_b", local_edges=0)


@query
def p3_group_sizes(spark, d):
    """How many groups there are of each size."""
    pairs = table(spark, d, "match_pairs").filter("lower(verdict) = 'match'")
    sizes = linking.linked_groups(pairs, "row_a", "row_b").groupBy("group_id").agg(F.count("*").alias("contacts"))
    return sizes.groupBy("contacts").agg(F.count("*").alias("groups"))


@query
def p4_found(spark, d):
    keyed = copies.canonical_contacts(table(spark, d, "contact_rows"), table(spark, d, "phones"))
    return copies.count_copies(keyed, "canonical", "row_id").filter("copies >= 2")


@query
def p4_records(spark, d):
    """One row per distinct record, those without copies included."""
    keyed = copies.canonical_contacts(table(spark, d, "contact_rows"), table(spark, d, "phones"))
    return copies.count_copies(keyed, "canonical", "row_id")


def _candidates(spark, d):
    return survivors.candidates(table(spark, d, "group_members"), table(spark, d, "contact_rows"), table(spark, d, "contact_files"))


@query
def p5_found(spark, d):
    return survivors.surviving_values(_candidates(spark, d))


@query
def p5_learned(spark, d):
    """The same with untimed members placed by learned transitions instead of first."""
    return survivors.surviving_values(_candidates(spark, d), "learned")


@query
def p5_records(spark, d):
    """One built record per group: the surviving value of each field."""
    c = cut(_candidates(spark, d), "candidates")
    kept = survivors.surviving_values(c).join(c.select("group_id", "field_name", "row_id", "value"), ["group_id", "field_name", "row_id"])
    cells = [F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in survivors.FIELDS]
    return kept.groupBy("group_id").agg(*cells)


@query
def p8_packed(spark, d):
    return packing.packed_documents(table(spark, d, "documents"))


@query
def p8_containers(spark, d):
    return packing.containers(packing.packed_documents(table(spark, d, "documents")))


@query
def p8_summary(spark, d):
    """Containers, tokens, unused space and the least containers that could hold them."""
    c = packing.containers(packing.packed_documents(table(spark, d, "documents")))
    return c.agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("unused").alias("unused"),
        F.ceil(F.sum("tokens") / packing.CAPACITY).alias("least"), F.max("tokens").alias("fullest"),
    )


@query
def p9_found(spark, d):
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def p9_near(spark, d):
    """Also passages with a word or two changed, added or left out."""
    return leaks.near_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def p9_items(spark, d):
    """Which test items leaked, into how many documents."""
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark")).groupBy("item_id").agg(F.count("*").alias("documents"))


@query
def p10_found(spark, d):
    return cuts.cut_documents(table(spark, d, "documents")).select("doc_id")


@query
def p10_reasons(spark, d):
    return cuts.cut_documents(table(spark, d, "documents"))


@query
def p10_sources(spark, d):
    return cuts.cut_shares(table(spark, d, "documents"))


def all_queries() -> dict[str, Query]:
    return dict(_ALL)
