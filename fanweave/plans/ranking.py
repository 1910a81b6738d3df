"""Rankings: fans (M1), influence (M2), most-connected user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import tie_key
from ..operators.degrees import in_degrees, max_degree, out_degrees
from ..operators.graph import FollowGraph, attributes_of
from ..operators.pagerank import pagerank
from ..operators.placement import with_positions


def fan_ranking(graph: FollowGraph) -> DataFrame:
    """M1: (id, name, intro, fans) for users with at least one fan, most fans first.

    A1 -> J1 (inner: zero-fan users drop out) -> O1.  Every vertex with a fan
    is an edge endpoint, so the fan counts only need the users' attributes
    (default "Unknown"): one pass over the edges, not two.  Both sides are
    hash-partitioned on the id by their aggregations, so the join adds no
    exchange; the sort is a range-partitioned total sort.
    """
    fans = in_degrees(graph.edges, "fans")
    return (attributes_of(graph, fans)
            .select("id", "name", "intro", "fans")
            .orderBy(F.desc("fans"), F.asc("id")))


def top_fans(graph: FollowGraph, k: int = 10) -> DataFrame:
    """O3: the k users with most fans (per-partition top-k, then a k-row merge)."""
    return fan_ranking(graph).limit(k)


def influence_ranking(graph: FollowGraph, ranks: DataFrame | None = None) -> DataFrame:
    """M2: (id, name, intro, rank) for every vertex, most influential first.
    The graph is materialized once and shared by PageRank and the final join."""
    if ranks is None:
        graph = graph.materialize()
        ranks = pagerank(graph)
    return (graph.vertices.join(ranks, "id")
            .select("id", "name", "intro", "rank")
            .orderBy(tie_key(F.col("rank")).desc(), F.asc("id")))


def top_influence(graph: FollowGraph, k: int = 10, ranks: DataFrame | None = None) -> DataFrame:
    return influence_ranking(graph, ranks).limit(k)


def fan_positions(graph: FollowGraph) -> DataFrame:
    """O1: the fan ranking with every user's exact place, from 1."""
    return with_positions(fan_ranking(graph), [F.desc("fans"), F.asc("id")])


def influence_positions(graph: FollowGraph, ranks: DataFrame | None = None) -> DataFrame:
    """O2: the influence ranking with every vertex's exact place, from 1."""
    return with_positions(influence_ranking(graph, ranks),
                          [tie_key(F.col("rank")).desc(), F.asc("id")])


def store_positions(ranking: DataFrame, path: str) -> None:
    """Write a ranking with places so that files hold ranges of places."""
    ranking.repartitionByRange("position").sortWithinPartitions("position").write.parquet(path)


def page(spark, path: str, first: int, count: int) -> DataFrame:
    """``count`` rows of a stored ranking from place ``first`` on; the place is pushed down to the
    scan, which skips the files and row groups of other places."""
    at = F.col("position")
    return spark.read.parquet(path).where((at >= first) & (at < first + count)).orderBy("position")


def max_in_degree(graph: FollowGraph) -> DataFrame:
    """The most-followed vertex (id, degree); ties -> smallest id."""
    return max_degree(in_degrees(graph.edges, "degree"), "degree")


def max_out_degree(graph: FollowGraph) -> DataFrame:
    """The vertex following most others (id, degree); ties -> smallest id."""
    return max_degree(out_degrees(graph.edges, "degree"), "degree")


def most_active(graph: FollowGraph, k: int = 1) -> DataFrame:
    """(id, degree) of the k vertices that follow most others; ties -> smallest id."""
    return (out_degrees(graph.edges, "degree")
            .orderBy(F.desc("degree"), F.asc("id")).limit(k))


def top_creators(graph: FollowGraph, k: int = 1) -> DataFrame:
    """(id, fans) of the k most-followed vertices; ties -> smallest id."""
    return (in_degrees(graph.edges, "fans")
            .orderBy(F.desc("fans"), F.asc("id")).limit(k))
