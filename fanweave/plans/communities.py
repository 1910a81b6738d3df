"""Communities: census (M5), sub-network extraction (M6), label propagation
communities (M9) and isolated users (M10).

Size logic uses counts (``groupBy().count()``), never member lists: a giant
component can hold a third of all users, so members stay one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import EXTRACT_MAX, EXTRACT_MIN, SIZE_BANDS, members_line, size_band
from ..operators.components import connected_components
from ..operators.graph import FollowGraph
from ..operators.labelprop import label_propagation
from ..operators.neighborhood import absent_from, edges_of_components
from ..operators.placement import member_chunks


def community_members(graph: FollowGraph, labels: DataFrame | None = None) -> DataFrame:
    """(component, id, name) for every vertex."""
    if labels is None:
        graph = graph.materialize()
        labels = connected_components(graph)
    return graph.vertices.join(labels, "id").select("component", "id", "name")


def community_sizes(labels: DataFrame) -> DataFrame:
    """A3: (component, size)."""
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def community_census(graph: FollowGraph, labels: DataFrame | None = None) -> DataFrame:
    """(band, communities) for bands 1, 2-4, 5-9, 10+; empty bands show 0.

    One aggregation over the component sizes; the four band names are a
    fixed 4-row table (broadcast by size: it never grows)."""
    labels = labels if labels is not None else connected_components(graph)
    spark = graph.edges.sparkSession
    counted = (community_sizes(labels).groupBy(size_band(F.col("size")).alias("band"))
               .agg(F.count(F.lit(1)).alias("communities")))
    bands = spark.createDataFrame([(b,) for b in SIZE_BANDS], "band string")
    return (F.broadcast(bands).join(counted, "band", "left")
            .select("band", F.coalesce("communities", F.lit(0)).cast("long").alias("communities")))


def isolated_users(graph: FollowGraph, labels: DataFrame | None = None) -> DataFrame:
    """Users alone in their component, as (component, line) with
    line = ``component->name`` (a one-member list, so formatting is bounded)."""
    if labels is None:
        graph = graph.materialize()
        labels = connected_components(graph)
    single = community_sizes(labels).where("size = 1").select("component")
    members = community_members(graph, labels).join(single, "component")
    return members.select("component",
                          members_line(F.col("component"), F.array(F.col("name"))).alias("line"))


def members_in_band(labels: DataFrame, lo: int = EXTRACT_MIN, hi: int = EXTRACT_MAX) -> DataFrame:
    """(id) of vertices whose component size n satisfies lo <= n < hi."""
    chosen = community_sizes(labels).where((F.col("size") >= lo) & (F.col("size") < hi))
    return labels.join(chosen.select("component"), "component").select("id", "component")


def community_edges(graph: FollowGraph, labels: DataFrame | None = None,
                    existing: DataFrame | None = None,
                    lo: int = EXTRACT_MIN, hi: int = EXTRACT_MAX) -> DataFrame:
    """M6: (Source, Target, Type) of every edge touching a member of a
    component with lo <= size < hi, each once; with ``existing`` only the
    edges not stored yet (insert-if-absent)."""
    if labels is None:
        graph = graph.materialize()
        labels = connected_components(graph)
    members = members_in_band(labels, lo, hi)
    return absent_from(edges_of_components(graph.edges, members), existing)


def lpa_labels(graph: FollowGraph, steps: int | None = None) -> DataFrame:
    """(id, label)."""
    return label_propagation(graph) if steps is None else label_propagation(graph, steps)


def lpa_communities(labels: DataFrame, min_size: int = 10) -> DataFrame:
    """(label, size) of label groups with more than ``min_size`` members."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return sizes.where(F.col("size") > min_size)


def lpa_community_members(labels: DataFrame, min_size: int = 10) -> DataFrame:
    """M9 members: (label, id) for label groups with more than ``min_size`` members."""
    big = lpa_communities(labels, min_size).select("label")
    return labels.join(big, "label").select("label", "id")


def member_lines(chunks: DataFrame, key: str) -> DataFrame:
    """(key, chunk_no, n, line) from lists of members. The lines of a key, put together in
    the order of ``chunk_no``, are its ``key->a,b,c`` text: the first one carries the key, the others
    go on with a comma."""
    first = members_line(F.col(key), F.col("members"))
    later = F.concat(F.lit(","), F.array_join("members", ","))
    return chunks.select(key, "chunk_no", F.size("members").cast("long").alias("n"),
                         F.when(F.col("chunk_no") == 0, first).otherwise(later).alias("line"))


def community_member_lines(graph: FollowGraph, labels: DataFrame | None = None,
                           size: int = 1000) -> DataFrame:
    """A2: (component, chunk_no, n, line), the names of every component's members by id."""
    members = community_members(graph, labels).withColumn("name", F.coalesce("name", F.lit("")))
    return member_lines(member_chunks(members, "component", "name", size=size), "component")


def lpa_member_lines(labels: DataFrame, min_size: int = 10, size: int = 1000) -> DataFrame:
    """M9: (label, chunk_no, n, line), the ids of every label group of more than ``min_size``."""
    members = lpa_community_members(labels, min_size).withColumn("member", F.col("id").cast("string"))
    return member_lines(member_chunks(members, "label", "member", size=size), "label")
