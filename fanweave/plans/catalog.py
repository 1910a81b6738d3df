"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the test tables and derives one of two follower graphs from
all of their rows (full / orders, see ``sources.tpch_graphs``).  Floating
results are rounded to 6 places; rank ties are broken on 9 places.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import round6
from ..operators.components import connected_components, strongly_connected_components
from ..operators.degrees import in_degrees
from ..operators.graph import FollowGraph, assemble
from ..operators.pagerank import pagerank
from ..session import ensure_checkpoint_dir, scratch_path
from ..sources import documents, edge_index, graphml
from ..sources import tpch_graphs as tg
from ..sources.readers import ALT_LAYOUT, follows_from, read_follows, read_users, users_from
from ..sources.sinks import write_table
from ..streaming import component_stream
from . import communities as cm
from . import jobs
from . import networks as nw
from . import ranking as rk
from . import recommend as rc


def graph_of(spark: SparkSession, sf_dir: str, kind: str) -> FollowGraph:
    users = users_from(tg.users_table(spark, sf_dir, kind))
    follows = follows_from(tg.follow_table(spark, sf_dir, kind))
    return assemble(users, follows)


def _most_active(graph: FollowGraph, k: int = 1) -> DataFrame:
    """The ``k`` users following most others (ties -> smallest id), as ``id`` rows."""
    return rk.most_active(graph, k).select("id")


def _creator(graph: FollowGraph, k: int = 1) -> DataFrame:
    return rk.top_creators(graph, k).select("id")


# ----------------------------------------------------------------- scans / graph


def q_users_scan(spark, sf):
    return read_users(spark, f"{sf}/customer.parquet", id_col="c_custkey",
                      name_col="c_name", intro_col="c_mktsegment")


def q_follow_scan(spark, sf):
    return follows_from(tg.follow_table(spark, sf, "full"))


def q_follow_scan_alt_layout(spark, sf):
    alt = tg.follow_table(spark, sf, "full").select(
        F.col("Source").alias(ALT_LAYOUT["src_col"]), F.col("Target").alias(ALT_LAYOUT["dst_col"]))
    return follows_from(alt, **ALT_LAYOUT)


def q_follow_documents(spark, sf):
    """The follow collection stored as JSON documents and read back."""
    path = f"{_store(spark)}/follow"
    write_table(tg.follow_table(spark, sf, "full"), path, "append", documents.FORMAT)
    return read_follows(spark, path, documents.FORMAT)


def q_graph_vertices(spark, sf):
    return graph_of(spark, sf, "full").vertices


def q_fan_edge_subgraph(spark, sf):
    g = graph_of(spark, sf, "full")
    return nw.fan_subgraph(g, _creator(g)).edges


def q_fan_subgraph_vertices(spark, sf):
    g = graph_of(spark, sf, "full")
    return nw.fan_subgraph(g, _creator(g)).vertices


def q_graph_nodes_export(spark, sf):
    return nw.graph_export(graph_of(spark, sf, "orders"))[0]


def q_graph_edges_export(spark, sf):
    return nw.graph_export(graph_of(spark, sf, "orders"))[1]


def _drawn(spark, sf):
    path = f"{_store(spark)}/drawing"
    nw.drawing(graph_of(spark, sf, "full"), path)
    return graphml.read_graphml(spark, path)


def q_graph_drawing_nodes(spark, sf):
    """The nodes of the drawing's document, read back from its fragments."""
    return _drawn(spark, sf)[0]


def q_graph_drawing_edges(spark, sf):
    return _drawn(spark, sf)[1]


# ----------------------------------------------------------------- degrees / rankings


def q_fan_counts(spark, sf):
    return in_degrees(graph_of(spark, sf, "full").edges, "fans")


def q_max_in_degree(spark, sf):
    return rk.max_in_degree(graph_of(spark, sf, "full"))


def q_max_out_degree(spark, sf):
    return rk.max_out_degree(graph_of(spark, sf, "full"))


def q_fan_ranking(spark, sf):
    return rk.fan_ranking(graph_of(spark, sf, "full"))


def q_fan_positions(spark, sf):
    return rk.fan_positions(graph_of(spark, sf, "full"))


def q_fan_page(spark, sf):
    """Places 101 to 150 of a stored ranking."""
    path = f"{_store(spark)}/positions"
    rk.store_positions(rk.fan_positions(graph_of(spark, sf, "full")), path)
    return rk.page(spark, path, 101, 50)


def q_top_fans(spark, sf):
    return rk.top_fans(graph_of(spark, sf, "full"), 10)


def q_pagerank(spark, sf):
    return pagerank(graph_of(spark, sf, "full")).select("id", round6(F.col("rank")).alias("rank"))


def q_influence_ranking(spark, sf):
    r = rk.influence_ranking(graph_of(spark, sf, "full"))
    return r.select("id", "name", "intro", round6(F.col("rank")).alias("rank"))


def q_top_influence(spark, sf):
    r = rk.top_influence(graph_of(spark, sf, "full"), 10)
    return r.select("id", "name", "intro", round6(F.col("rank")).alias("rank"))


# ----------------------------------------------------------------- recommendations


def q_personalized_pagerank_one(spark, sf):
    g = graph_of(spark, sf, "full").materialize()
    r = rc.personalized_ranks_of(g, _most_active(g))
    return r.select("id", round6(F.col("rank")).alias("rank"))


def q_recommend_one(spark, sf):
    g = graph_of(spark, sf, "full").materialize()
    return rc.recommend_one(g, _most_active(g, 20))


def q_personal_recommendations(spark, sf):
    return rc.personal_recommendations(graph_of(spark, sf, "orders"))


# ----------------------------------------------------------------- communities


def q_connected_components(spark, sf):
    return connected_components(graph_of(spark, sf, "full"))


def q_connected_components_sparse(spark, sf):
    return connected_components(graph_of(spark, sf, "orders"))


def q_components_of_a_stream(spark, sf):
    """The follows arrive as files, one in a micro-batch; the stored components in the end."""
    g, store = graph_of(spark, sf, "orders").materialize(), _store(spark)
    follows = g.edges.select(F.col("src").alias("Source"), F.col("dst").alias("Target"))
    follows.repartition(3).write.parquet(f"{store}/follow")
    stream = (spark.readStream.schema(follows.schema).option("maxFilesPerTrigger", 1)
              .parquet(f"{store}/follow"))
    component_stream.watch_components(stream, store, f"{store}/checkpoint").awaitTermination()
    found = component_stream.components(spark, store)
    return g.vertices.select("id").join(found, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"))


def q_community_members(spark, sf):
    return cm.community_members(graph_of(spark, sf, "orders"))


def q_community_member_lines(spark, sf):
    return cm.community_member_lines(graph_of(spark, sf, "orders"))


def q_community_sizes(spark, sf):
    return cm.community_sizes(connected_components(graph_of(spark, sf, "orders")))


def q_community_census(spark, sf):
    return cm.community_census(graph_of(spark, sf, "orders"))


def q_isolated_users(spark, sf):
    return cm.isolated_users(graph_of(spark, sf, "orders"))


def q_community_edges(spark, sf):
    return cm.community_edges(graph_of(spark, sf, "orders"))


def q_community_edges_incremental(spark, sf):
    """Widen the band from [10, 15) (already stored) to [10, 20): only the
    edges of components of size 15-19 are new."""
    g = graph_of(spark, sf, "orders").materialize()
    labels = connected_components(g)
    stored = cm.community_edges(g, labels, lo=10, hi=15)
    return cm.community_edges(g, labels, existing=stored)


def q_strongly_connected_components(spark, sf):
    return strongly_connected_components(graph_of(spark, sf, "full"))


def q_label_propagation(spark, sf):
    return cm.lpa_labels(graph_of(spark, sf, "full"))


def q_lpa_communities(spark, sf):
    return cm.lpa_communities(cm.lpa_labels(graph_of(spark, sf, "full")))


def q_lpa_community_members(spark, sf):
    return cm.lpa_community_members(cm.lpa_labels(graph_of(spark, sf, "full")))


def q_lpa_member_lines(spark, sf):
    return cm.lpa_member_lines(cm.lpa_labels(graph_of(spark, sf, "full")))


# ----------------------------------------------------------------- sub-networks


def q_fan_sample(spark, sf):
    g = graph_of(spark, sf, "full")
    return nw.sampled_fans(g, _creator(g, 20))


def q_fan_sample_all_creators(spark, sf):
    """The 10 % fan sample of every followed vertex at once."""
    g = graph_of(spark, sf, "full")
    return nw.sampled_fans(g, in_degrees(g.edges).select("id"))


def q_fan_ego_edges(spark, sf):
    g = graph_of(spark, sf, "full")
    return nw.fan_ego_edges(g, _creator(g))


def q_creator_fan_star(spark, sf):
    g = graph_of(spark, sf, "full").materialize()
    star = nw.creator_fan_star(g, _creator(g, 3), pagerank(g))
    return star.select("Source", "Target", round6(F.col("Weight")).alias("Weight"), "Type")


def _band_members(spark, sf):
    g = graph_of(spark, sf, "orders").materialize()
    return g, cm.members_in_band(connected_components(g)).select("id")


def q_id_list_roundtrip(spark, sf):
    _, ids = _band_members(spark, sf)
    ensure_checkpoint_dir(spark)
    return nw.id_list_roundtrip(ids, scratch_path(spark, "id-list"))


def q_id_list_edges(spark, sf):
    g, ids = _band_members(spark, sf)
    return nw.id_list_edges(g, ids)


def q_edge_lookup(spark, sf):
    """The edges around the band's members, looked up in the stored edges by either end."""
    g, ids = _band_members(spark, sf)
    name = f"follow_{uuid.uuid4().hex}"
    index = edge_index.write_index(g.edges, f"{_store(spark)}/follow", name)
    return edge_index.lookup_edges(index, ids, dedup=False)


# ----------------------------------------------------------------- jobs with their collections


def _store(spark):
    ensure_checkpoint_dir(spark)
    return scratch_path(spark, "store")


def q_job_top_k_fans(spark, sf):
    return jobs.top_k_fans(graph_of(spark, sf, "full"), _store(spark))


def q_job_top_k_up(spark, sf):
    out = jobs.top_k_up(graph_of(spark, sf, "full"), _store(spark))
    return out.select("id", "name", "intro", round6(F.col("rank")).alias("rank"))


def q_job_personal_rec(spark, sf):
    return jobs.personal_rec(graph_of(spark, sf, "orders"), _store(spark))


def q_job_top_up_fans(spark, sf):
    """The star read from a ranking that was stored twice."""
    g, store = graph_of(spark, sf, "full").materialize(), _store(spark)
    jobs.top_k_up(g, store)
    creators = jobs.top_k_up(g, store).select("id").distinct()
    star = jobs.top_up_fans(g, store, creators)
    return star.select("Source", "Target", round6(F.col("Weight")).alias("Weight"), "Type")


def q_job_fans_of(spark, sf):
    """Run twice: the second run adds nothing."""
    g, store = graph_of(spark, sf, "full").materialize(), _store(spark)
    jobs.fans_of(g, store, _creator(g, 3))
    return jobs.fans_of(g, store, _creator(g, 3))


def q_job_community(spark, sf):
    """Run twice: the second run adds nothing."""
    g, store = graph_of(spark, sf, "orders").materialize(), _store(spark)
    labels = connected_components(g)
    jobs.community(g, store, labels)
    return jobs.community(g, store, labels)


def q_job_community_documents(spark, sf):
    """The same on a collection of documents."""
    g, store = graph_of(spark, sf, "orders").materialize(), _store(spark)
    labels = connected_components(g)
    jobs.community(g, store, labels, documents.FORMAT)
    return jobs.community(g, store, labels, documents.FORMAT)


def q_job_top_k_up_documents(spark, sf):
    out = jobs.top_k_up(graph_of(spark, sf, "full"), _store(spark), format=documents.FORMAT)
    return out.select("id", "name", "intro", round6(F.col("rank")).alias("rank"))


def q_job_comu(spark, sf):
    g, ids = _band_members(spark, sf)
    return jobs.community_edges_of(g, _store(spark), ids)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "users_scan": q_users_scan,
    "follow_scan": q_follow_scan,
    "follow_scan_alt_layout": q_follow_scan_alt_layout,
    "follow_documents": q_follow_documents,
    "graph_drawing_nodes": q_graph_drawing_nodes,
    "graph_drawing_edges": q_graph_drawing_edges,
    "fan_positions": q_fan_positions,
    "fan_page": q_fan_page,
    "community_member_lines": q_community_member_lines,
    "lpa_member_lines": q_lpa_member_lines,
    "edge_lookup": q_edge_lookup,
    "job_community": q_job_community,
    "job_community_documents": q_job_community_documents,
    "job_top_k_up_documents": q_job_top_k_up_documents,
    "graph_vertices": q_graph_vertices,
    "fan_edge_subgraph": q_fan_edge_subgraph,
    "fan_subgraph_vertices": q_fan_subgraph_vertices,
    "graph_nodes_export": q_graph_nodes_export,
    "graph_edges_export": q_graph_edges_export,
    "fan_counts": q_fan_counts,
    "max_in_degree": q_max_in_degree,
    "max_out_degree": q_max_out_degree,
    "fan_ranking": q_fan_ranking,
    "top_fans": q_top_fans,
    "pagerank": q_pagerank,
    "influence_ranking": q_influence_ranking,
    "top_influence": q_top_influence,
    "personalized_pagerank_one": q_personalized_pagerank_one,
    "recommend_one": q_recommend_one,
    "personal_recommendations": q_personal_recommendations,
    "connected_components": q_connected_components,
    "connected_components_sparse": q_connected_components_sparse,
    "components_of_a_stream": q_components_of_a_stream,
    "community_members": q_community_members,
    "community_sizes": q_community_sizes,
    "community_census": q_community_census,
    "isolated_users": q_isolated_users,
    "community_edges": q_community_edges,
    "community_edges_incremental": q_community_edges_incremental,
    "fan_sample": q_fan_sample,
    "fan_sample_all_creators": q_fan_sample_all_creators,
    "fan_ego_edges": q_fan_ego_edges,
    "creator_fan_star": q_creator_fan_star,
    "id_list_roundtrip": q_id_list_roundtrip,
    "id_list_edges": q_id_list_edges,
    "strongly_connected_components": q_strongly_connected_components,
    "label_propagation": q_label_propagation,
    "lpa_communities": q_lpa_communities,
    "lpa_community_members": q_lpa_community_members,
    "job_top_k_fans": q_job_top_k_fans,
    "job_top_k_up": q_job_top_k_up,
    "job_personal_rec": q_job_personal_rec,
    "job_top_up_fans": q_job_top_up_fans,
    "job_fans_of": q_job_fans_of,
    "job_comu": q_job_comu,
}
