"""Connected components kept up to date as follows arrive.

The store is a forest in collections that only grow, each in buckets of its key:

    vertices  id          every vertex that was seen
    links     id, into    a root that was hung under another one; each id at most once
    sizes     id, size, epoch    how many vertices a root had after an epoch

A micro-batch finds the roots of its own endpoints, contracts its edges to edges between roots, and
runs ``connected_components`` on those alone. In every group the largest root wins and the others
are hung under it, so no path is longer than the logarithm of its component's size, and an endpoint's
root takes that many lookups, each in the buckets that the batch touches. Vertices and components that
a batch does not touch are neither read nor written.

A batch that is run again, whole or from where it broke off, finds its links stored and adds nothing
twice; sizes only balance the forest. Defined results: an edge from a vertex to itself makes it known;
a null endpoint is an error; rows of an edge that repeat change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.expr import required
from ..operators.components import connected_components
from ..operators.graph import from_edges
from ..operators.iterate import materialize
from ..sources.readers import follows_from
from ..sources.sinks import insert_into_buckets, read_table, stored_rows, write_table

BUCKETS = 64
_LINK = "id long, into long"


def _links_of(ids: DataFrame, store: str) -> DataFrame:
    """(id, into) of those of ``ids`` that hang under another vertex."""
    found = stored_rows(ids.select("id"), f"{store}/links", ("id",))
    return found if found is not None else ids.sparkSession.createDataFrame([], _LINK)


def roots_of(ids: DataFrame, store: str) -> DataFrame:
    """(id, root) of some vertices; an unknown one is its own root."""
    at, _ = materialize(ids.select("id", F.col("id").alias("root")).distinct())
    while True:
        asked, _ = materialize(at.select(F.col("root").alias("id")).distinct())
        up = _links_of(asked, store).select(F.col("id").alias("root"), "into")
        at, m = materialize(at.join(up, "root", "left").select(
            "id", F.coalesce("into", "root").alias("root"), F.col("into").isNotNull().alias("moved")),
            {"moved": F.expr("sum(CASE WHEN moved THEN 1 ELSE 0 END)")})
        at = at.select("id", "root")
        if not m["moved"]:
            return at


def _sizes_of(roots: DataFrame, store: str) -> DataFrame:
    """(id, size): the last stored size of some roots, 1 for new ones."""
    log = read_table(roots.sparkSession, f"{store}/sizes")
    if log is None:
        return roots.select("id", F.lit(1).cast("long").alias("size"))
    last = log.join(roots.select("id"), "id", "left_semi").groupBy("id").agg(
        F.max_by("size", "epoch").alias("size"))
    return roots.select("id").join(last, "id", "left").select("id", F.coalesce("size", F.lit(1))
                                                              .alias("size"))


def add_follows(follows: DataFrame, store: str, epoch: int) -> None:
    """Take follow rows (src, dst) into the store."""
    edges, _ = materialize(follows.select(required("src"), required("dst")).distinct())
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    insert_into_buckets(ids, f"{store}/vertices", ("id",), BUCKETS)
    root = roots_of(ids, store)
    source = root.select(F.col("id").alias("src"), F.col("root").alias("a"))
    target = root.select(F.col("id").alias("dst"), F.col("root").alias("b"))
    contracted, m = materialize(
        edges.join(source, "src").join(target, "dst").where("a <> b")
        .select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight"))
        .distinct(), {"n": F.count(F.lit(1))})
    if not m["n"]:
        return
    groups = connected_components(from_edges(contracted))
    sized, _ = materialize(groups.join(_sizes_of(groups, store), "id"))
    winner = sized.groupBy("component").agg(
        F.max_by("id", F.struct("size", -F.col("id"))).alias("into"), F.sum("size").alias("total"))
    hung, _ = materialize(sized.join(winner, "component").select("id", "into", "total"))
    write_table(hung.where("id = into").select("id", F.col("total").alias("size"),
                                               F.lit(epoch).cast("long").alias("epoch")),
                f"{store}/sizes")
    insert_into_buckets(hung.where("id <> into").select("id", "into"), f"{store}/links", ("id",),
                        BUCKETS)


def components(spark: SparkSession, store: str) -> DataFrame:
    """(id, component) of every vertex in the store, as ``connected_components`` labels it: by the
    smallest id. All links are followed at once, by pointer doubling."""
    vertices = read_table(spark, f"{store}/vertices")
    if vertices is None:
        return spark.createDataFrame([], "id long, component long")
    links = read_table(spark, f"{store}/links")
    links = spark.createDataFrame([], _LINK) if links is None else links.select("id", "into")
    at, m = materialize(links, {"n": F.count(F.lit(1))})
    while m["n"]:
        up = at.select(F.col("id").alias("into"), F.col("into").alias("next"))
        joined, m = materialize(at.join(up, "into", "left").select(
            "id", F.coalesce("next", "into").alias("into"), F.col("next").isNotNull().alias("moved")),
            {"n": F.expr("sum(CASE WHEN moved THEN 1 ELSE 0 END)")})
        at = joined.select("id", "into")
    root = vertices.select("id").join(at, "id", "left").select(
        "id", F.coalesce("into", "id").alias("root"))
    least = root.groupBy("root").agg(F.min("id").alias("component"))
    return root.join(least, "root").select("id", "component")


def watch_components(follow_stream: DataFrame, store: str, checkpoint_location: str,
                     src_col: str = "Source", dst_col: str = "Target",
                     available_now: bool = True) -> StreamingQuery:
    """Start a stream that keeps the store's components up to date with the follows that arrive."""
    def take(batch: DataFrame, epoch: int) -> None:
        add_follows(follows_from(batch, src_col, dst_col), store, epoch)

    writer = (follow_stream.writeStream.foreachBatch(take)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
