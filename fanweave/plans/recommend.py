"""Recommendations by personalized PageRank (M3, M4)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.graph import FollowGraph
from ..operators.pagerank import best_other, personalized_pagerank


def personal_recommendations(graph: FollowGraph, sources: DataFrame | None = None,
                             batches: int = 1, live_messages: int | None = None) -> DataFrame:
    """M3: (id, recId) for every vertex (or every id in ``sources``): the
    vertex with the highest personalized rank other than itself.  Sources run together,
    in groups of bounded size (``personalized_pagerank``); of a finished group only its
    recommendations are stored."""
    return personalized_pagerank(graph, sources, batches=batches, live_messages=live_messages,
                                 reduce=best_other)


def personalized_ranks_of(graph: FollowGraph, user: DataFrame) -> DataFrame:
    """X2 for one user (``user`` holds one ``id``): (id, rank) of every vertex it reaches."""
    return personalized_pagerank(graph, user).select("id", "rank")


def recommend_one(graph: FollowGraph, user: DataFrame) -> DataFrame:
    """M4: (id, recId) for the given user(s)."""
    return best_other(personalized_pagerank(graph, user))
