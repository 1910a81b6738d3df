"""Degrees (X6/A1) and the max-degree reducer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_degrees(edges: DataFrame, name: str = "fans") -> DataFrame:
    """(id, fans): number of edges into each vertex; parallel edges and self-loops count.

    Vertices without in-edges are absent (like GraphX inDegrees).  A partial
    aggregate runs before the shuffle, so a hot target costs one row per map task.
    """
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias(name))


def out_degrees(edges: DataFrame, name: str = "follows") -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias(name))


def max_degree(degrees: DataFrame, degree_col: str) -> DataFrame:
    """The single (id, degree) with the largest degree; ties -> smallest id.

    ``max_by`` over a struct key is a mergeable aggregate: no sort, no window.
    """
    key = F.struct(F.col(degree_col), -F.col("id"))
    best = degrees.agg(F.max_by(F.struct("id", degree_col), key).alias("best"))
    return best.where(F.col("best").isNotNull()).select("best.id", f"best.{degree_col}")
