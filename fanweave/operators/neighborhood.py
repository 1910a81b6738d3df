"""Edges around a set of vertices (J5/U1/U2/U3) and insert-if-absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import DIRECTED

RESULT_EDGE_COLUMNS = ("Source", "Target", "Type")


def _typed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("Source"), F.col("dst").alias("Target"),
                        F.lit(DIRECTED).alias("Type"))


def incident_edges(edges: DataFrame, members: DataFrame, dedup: bool = True) -> DataFrame:
    """Edges whose Source or Target is a member (column ``id``), typed "Directed".

    ``dedup=True`` (insert-if-absent sinks): each (Source, Target, Type) once.
    ``dedup=False`` (append sink): one row per lookup hit, i.e. out-edges plus
    in-edges of every listed id, repeated for repeated ids, so an edge between
    two members (or a self-loop) appears twice.
    """
    if dedup:
        ids = members.select("id").distinct()
        out = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
        inn = edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
        return _typed(out.unionByName(inn)).distinct()
    ids = members.select("id")
    out = edges.join(ids.select(F.col("id").alias("src")), "src")
    inn = edges.join(ids.select(F.col("id").alias("dst")), "dst")
    return _typed(out.select("src", "dst").unionByName(inn.select("src", "dst")))


def edges_of_components(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Incident edges when ``members`` is a union of whole (weakly) connected
    components: an edge never leaves its component, so the edges touching a
    member are exactly the edges whose Source is a member (one semi-join)."""
    ids = members.select(F.col("id").alias("src"))
    return _typed(edges.join(ids, "src", "left_semi")).distinct()


def absent_from(new_rows: DataFrame, existing: DataFrame | None,
                keys: tuple[str, ...] = RESULT_EDGE_COLUMNS) -> DataFrame:
    """Rows of ``new_rows`` (deduplicated) whose key is not in ``existing``."""
    fresh = new_rows.dropDuplicates(list(keys))
    if existing is None:
        return fresh
    return fresh.join(existing.select(*keys), list(keys), "left_anti")
