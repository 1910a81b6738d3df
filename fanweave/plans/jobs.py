"""The original jobs as runs: compute, write to the job's collection, read it back.

``store`` is the folder of all collections (any Spark path) and ``format`` how they are stored: Parquet
or any other source that Spark can append to, such as ``documents``. Plain inserts append, so a rerun
doubles the rows; edge collections insert what is absent, so a rerun adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import FollowGraph
from ..sources.sinks import insert_if_absent, insert_into_buckets, read_table, write_table
from . import communities as cm
from . import networks as nw
from . import ranking as rk
from . import recommend as rc


PARQUET = "parquet"


def _append(df: DataFrame, path: str, format: str) -> DataFrame:
    write_table(df, path, "append", format)
    return read_table(df.sparkSession, path, format)


def _insert(edges: DataFrame, path: str, format: str) -> DataFrame:
    """Parquet collections lie in buckets of the edge, so an insert reads the buckets of its own
    edges only; other formats are read whole."""
    if format == "parquet":
        insert_into_buckets(edges, path)
    else:
        insert_if_absent(edges, path, format=format)
    return read_table(edges.sparkSession, path, format)


def top_k_fans(graph: FollowGraph, store: str, k: int = 10, format: str = PARQUET) -> DataFrame:
    """K1: the users with most fans -> topKFans."""
    return _append(rk.top_fans(graph, k), f"{store}/topKFans", format)


def top_k_up(graph: FollowGraph, store: str, k: int = 10, format: str = PARQUET) -> DataFrame:
    """K2: the most influential users -> topKUp (id, name, intro, rank). Ranks are stored to 12
    places: further ones follow the order in which Spark adds, which differs between runs."""
    top = rk.top_influence(graph, k).withColumn("rank", F.round("rank", 12))
    return _append(top, f"{store}/topKUp", format)


def personal_rec(graph: FollowGraph, store: str, sources: DataFrame | None = None,
                 format: str = PARQUET) -> DataFrame:
    """K3: a recommendation for every user -> personalRec."""
    return _append(rc.personal_recommendations(graph, sources), f"{store}/personalRec", format)


def top_up_fans(graph: FollowGraph, store: str, creators: DataFrame,
                format: str = PARQUET) -> DataFrame:
    """K4: the star of the creators' fans, weighted by the rank that ``top_k_up`` stored
    -> topUpFans. However often the ranking was appended, a creator has one rank."""
    ranks = read_table(creators.sparkSession, f"{store}/topKUp", format)
    if ranks is None:
        raise ValueError("the star reads the stored ranking: run top_k_up first")
    return _append(nw.creator_fan_star(graph, creators, ranks.select("id", "rank")),
                   f"{store}/topUpFans", format)


def fans_of(graph: FollowGraph, store: str, creators: DataFrame,
            format: str = PARQUET) -> DataFrame:
    """K6: sampled fans through a text file of ids, the edges around them -> fansOf, each once."""
    edges = nw.fan_ego_edges(graph, creators, id_list_path=f"{store}/fan-ids")
    return _insert(edges, f"{store}/fansOf", format)


def community(graph: FollowGraph, store: str, labels: DataFrame | None = None,
              format: str = PARQUET) -> DataFrame:
    """K5: the edges around every community of 10 to 19 members -> community, each once."""
    return _insert(cm.community_edges(graph, labels), f"{store}/community", format)


def community_edges_of(graph: FollowGraph, store: str, ids: DataFrame,
                       format: str = PARQUET) -> DataFrame:
    """K7: all edges out of and into the listed ids, not de-duplicated -> comu."""
    return _append(nw.id_list_edges(graph, ids.select(F.col("id"))), f"{store}/comu", format)
