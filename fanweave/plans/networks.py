"""Sub-networks for storage or drawing: fan ego network (M7), creators'
weighted fan star (M8), edges around an id list (M11) and graph export (M12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import DIRECTED, FAN_SAMPLE_FRACTION
from ..operators.graph import FollowGraph, export_edges, export_nodes, from_edges
from ..operators.neighborhood import absent_from, incident_edges
from ..operators.sampling import fan_sample
from ..sources.readers import read_id_list
from ..sources.graphml import write_graphml
from ..sources.sinks import write_id_list


def fan_edges(graph: FollowGraph, creators: DataFrame) -> DataFrame:
    """Edges into the creators (column ``id``).  A semi-join: Spark
    broadcasts the creator list only when its (estimated or, with adaptive
    execution, measured) size is under the broadcast threshold, else shuffles."""
    return graph.edges.join(creators.select(F.col("id").alias("dst")).distinct(),
                            "dst", "left_semi").select("src", "dst", "weight")


def fan_subgraph(graph: FollowGraph, creators: DataFrame) -> FollowGraph:
    """The graph made only of the fan edges of the creators."""
    return from_edges(fan_edges(graph, creators))


def sampled_fans(graph: FollowGraph, creators: DataFrame,
                 fraction: float = FAN_SAMPLE_FRACTION) -> DataFrame:
    """(creator, fan), the first floor(fraction * n) fan edges per creator."""
    return fan_sample(graph.edges, creators, fraction)


def fan_ego_edges(graph: FollowGraph, creators: DataFrame, fraction: float = FAN_SAMPLE_FRACTION,
                  id_list_path: str | None = None, existing: DataFrame | None = None) -> DataFrame:
    """M7: edges in and out of each sampled fan, each (Source, Target, Type) once.

    With ``id_list_path`` the sampled fan ids go through a text file (K8 then
    S4), as in the original job; ``existing`` makes it insert-if-absent."""
    fans = sampled_fans(graph, creators, fraction).select(F.col("fan").alias("id"))
    if id_list_path is not None:
        write_id_list(fans, id_list_path)
        fans = read_id_list(graph.edges.sparkSession, id_list_path)
    return absent_from(incident_edges(graph.edges, fans, dedup=True), existing)


def creator_fan_star(graph: FollowGraph, creators: DataFrame, ranks: DataFrame) -> DataFrame:
    """M8: (Source, Target, Weight, Type) for every fan edge of every creator,
    weighted by the creator's stored rank (``ranks``: id, rank).  A creator
    without a rank yields no rows (inner join); one whose rank is stored more
    than once (an appended rerun) still gives each edge once.  Ranks are cut down to the
    creators first, so the join's small side is one row per creator."""
    star = fan_edges(graph, creators)
    creator_rank = (ranks.join(creators.select("id").distinct(), "id", "left_semi")
                    .groupBy("id").agg(F.max("rank").alias("rank")))
    return (star.join(creator_rank, star.dst == creator_rank.id)
            .select(F.col("src").alias("Source"), F.col("dst").alias("Target"),
                    F.col("rank").alias("Weight"), F.lit(DIRECTED).alias("Type")))


def id_list_edges(graph: FollowGraph, ids: DataFrame) -> DataFrame:
    """Out-edges then in-edges of every listed id, no dedup (append sink)."""
    return incident_edges(graph.edges, ids, dedup=False)


def id_list_roundtrip(ids: DataFrame, path: str) -> DataFrame:
    """K8 + S4: write ids as text lines, read them back."""
    write_id_list(ids, path)
    return read_id_list(ids.sparkSession, path)


def graph_export(graph: FollowGraph) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) tables for a drawing tool."""
    return export_nodes(graph), export_edges(graph)


def drawing(graph: FollowGraph, path: str) -> None:
    """M12 as one GraphML document in ordered fragments (see ``sources.graphml``)."""
    nodes, edges = graph_export(graph)
    write_graphml(nodes, edges, path)
