"""Property graph held as two DataFrames, plus assembly, subgraph and export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import EXPORT_CLASS, UNKNOWN, edge_key, required

_ATTR = T.StructType([T.StructField("name", T.StringType()),
                      T.StructField("intro", T.StringType())])


@dataclass(frozen=True)
class FollowGraph:
    """vertices: (id LONG, name STRING, intro STRING), one row per id.
    edges: (src LONG, dst LONG, weight DOUBLE), parallel edges and self-loops kept."""

    vertices: DataFrame
    edges: DataFrame
    # Edge count, known once both tables are checkpointed (see ``materialize``).
    n_edges: int | None = None
    # (id, attr struct<name, intro>) of the users, one row per id, when known:
    # lets a job that only needs attributes of edge endpoints skip the vertex table.
    user_attrs: DataFrame | None = None
    # Where ``materialize`` stored the edges.
    edges_path: str | None = None

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> "FollowGraph":
        return FollowGraph(self.vertices.persist(level), self.edges.persist(level))

    def materialize(self) -> "FollowGraph":
        """Cut both tables' lineage (one pass over the sources, however many
        times the graph is read afterwards): the vertices with a reliable
        checkpoint, the edges as Parquet, a fraction of its size.  A
        graph that is already materialized is returned as it is."""
        return self.materialize_counted()[0]

    def materialize_counted(self) -> tuple["FollowGraph", int]:
        """``materialize`` that also returns the number of edges."""
        if self.n_edges is not None:
            return self, self.n_edges
        from pyspark.sql import functions as F

        from .iterate import materialize, store_table
        v, _ = materialize(self.vertices)
        e, m, path = store_table(self.edges, {"n": F.count(F.lit(1))})
        n = int(m["n"] or 0)
        return FollowGraph(v, e, n, self.user_attrs, path), n

    def release(self) -> None:
        """Delete what ``materialize`` stored: nothing reads this graph any more."""
        from .iterate import release
        release(self.vertices, self.edges_path)

    def unpersist(self) -> None:
        self.vertices.unpersist()
        self.edges.unpersist()


def assemble(users: DataFrame, follows: DataFrame,
             default: tuple[str, str] = (UNKNOWN, UNKNOWN)) -> FollowGraph:
    """G1: every user plus every edge endpoint becomes a vertex.

    A null id or endpoint is an error, as a row is never dropped silently.
    Endpoints without a user row get the ``default`` attributes; a duplicated
    user id keeps its smallest (name, intro).  The endpoint ids come from one
    pass over the edges (``explode``) and are de-duplicated by a hash
    aggregate on the long id (map-side combine absorbs a celebrity id); only
    the users table goes through the string-keyed "smallest attributes"
    aggregate.  Both sides leave hash-partitioned on ``id``, so the final
    outer join adds no exchange.
    """
    edges = follows.select(required("src"), required("dst"),
                           F.col("weight").cast("double").alias("weight"))
    users = users.select(required("id"), "name", "intro")
    attrs = (users.groupBy("id").agg(F.min(F.struct("name", "intro").cast(_ATTR)).alias("attr")))
    ids = (edges.select(F.explode(F.array("src", "dst")).alias("id"))
           .unionByName(users.select("id"))
           .distinct())
    known = F.col("attr").isNotNull()
    vertices = ids.join(attrs, "id", "left").select(
        "id",
        F.when(known, F.col("attr.name")).otherwise(F.lit(default[0])).alias("name"),
        F.when(known, F.col("attr.intro")).otherwise(F.lit(default[1])).alias("intro"))
    return FollowGraph(vertices, edges, user_attrs=attrs)


def attributes_of(graph: FollowGraph, ids: DataFrame,
                  default: tuple[str, str] = (UNKNOWN, UNKNOWN)) -> DataFrame:
    """(id, name, intro) for ``ids`` that are vertices of ``graph`` (e.g. edge
    endpoints), from the user attributes when the graph keeps them, so the
    vertex table (a pass over all edges) is not needed."""
    if graph.user_attrs is None:
        return ids.join(graph.vertices, "id")
    known = F.col("attr").isNotNull()
    return ids.join(graph.user_attrs, "id", "left").select(
        *[c for c in ids.columns],
        F.when(known, F.col("attr.name")).otherwise(F.lit(default[0])).alias("name"),
        F.when(known, F.col("attr.intro")).otherwise(F.lit(default[1])).alias("intro"))


def from_edges(edges: DataFrame, default: tuple[str, str] = (UNKNOWN, UNKNOWN)) -> FollowGraph:
    """A graph whose vertices are exactly the endpoints of ``edges``."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    vertices = ids.select("id", F.lit(default[0]).alias("name"), F.lit(default[1]).alias("intro"))
    return FollowGraph(vertices, edges)


def export_nodes(graph: FollowGraph) -> DataFrame:
    """G5 nodes for drawing: id, label (the id as text), class."""
    return graph.vertices.select("id", F.col("id").cast("string").alias("label"),
                                 F.lit(EXPORT_CLASS).alias("class"))


def export_edges(graph: FollowGraph) -> DataFrame:
    """G5 edges for drawing: edge_id ``src-dst``, src, dst, directed."""
    e = graph.edges
    return e.select(edge_key(F.col("src"), F.col("dst")).alias("edge_id"), "src", "dst",
                    F.lit(True).alias("directed"))
