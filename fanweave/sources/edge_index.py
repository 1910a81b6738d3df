"""Follow edges stored for lookups by either end.

The edges are stored twice as Spark tables, bucketed and sorted by Source and by Target. A lookup
joins its members, shuffled to the same buckets, with the stored table as it lies: the edges are not
exchanged, and each task reads one bucket. Tables are external: ``open_index`` makes them known to
another session.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import DIRECTED

BUCKETS = 64


@dataclass(frozen=True)
class EdgeIndex:
    """Tables (src, dst) by source and by target, in ``buckets`` buckets each."""
    by_source: DataFrame
    by_target: DataFrame
    buckets: int


def _names(name: str) -> list[tuple[str, str]]:
    return [(f"{name}_by_source", "src"), (f"{name}_by_target", "dst")]


def write_index(edges: DataFrame, path: str, name: str, buckets: int = BUCKETS) -> EdgeIndex:
    """Store edges (src, dst) under ``path`` as tables ``name``_by_source and ``name``_by_target.
    Parallel edges and self-loops are kept. Rows are dealt to the buckets before they are written,
    so a bucket is one sorted file."""
    for table, key in _names(name):
        (edges.select("src", "dst").repartition(buckets, key).write.format("parquet")
         .bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{key}").saveAsTable(table))
    return open_index(edges.sparkSession, path, name, buckets)


def open_index(spark: SparkSession, path: str, name: str, buckets: int = BUCKETS) -> EdgeIndex:
    """The stored tables; they are registered in this session if they are not."""
    for table, key in _names(name):
        if not spark.catalog.tableExists(table):
            spark.sql(f"CREATE TABLE {table} (src BIGINT, dst BIGINT) USING parquet "
                      f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {int(buckets)} BUCKETS "
                      f"LOCATION '{path}/{key}'")
    return EdgeIndex(*(spark.table(table) for table, _ in _names(name)), buckets)


def drop_index(spark: SparkSession, name: str) -> None:
    """Forget the tables; the files stay."""
    for table, _ in _names(name):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _found(index: EdgeIndex, members: DataFrame, how: str) -> tuple[DataFrame, DataFrame]:
    ids = members.select("id")
    if how == "left_semi":
        ids = ids.distinct()
    return tuple(
        # merge: a broadcast or hash join would not need the sorted buckets, nor be as bounded
        table.join(ids.select(F.col("id").alias(key)).hint("merge"), key, how).select("src", "dst")
        for table, key in ((index.by_source, "src"), (index.by_target, "dst")))


def _typed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("Source"), F.col("dst").alias("Target"),
                        F.lit(DIRECTED).alias("Type"))


def lookup_edges(index: EdgeIndex, members: DataFrame, dedup: bool = True) -> DataFrame:
    """Edges out of and into the members (column ``id``), as ``neighborhood.incident_edges`` gives
    them: each (Source, Target, Type) once, or one row per hit with ``dedup=False``."""
    out, inn = _found(index, members, "left_semi" if dedup else "inner")
    both = _typed(out.unionByName(inn))
    return both.distinct() if dedup else both
