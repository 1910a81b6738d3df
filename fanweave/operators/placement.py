"""Exact places of rows in an order, overall or within a key, without a window over a hot key.

The rows are range-partitioned by (key, order), which splits a key of any size between its rows. Each
partition counts its rows per key; the counts are one small row per key and partition, and their running
sums say what comes before a partition. A window within (key, partition) does the rest. Every task
holds one range of rows; nothing but the range bounds passes the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import loop_partitions
from .iterate import fixed_partitioning, materialize

_PART = "__fw_part"
ROWS_PER_RANGE = 250_000


def ranges_of(spark: SparkSession, rows: int) -> int:
    """The number of partitions that ``rows`` are dealt over."""
    return max(loop_partitions(spark, rows), -(-rows // ROWS_PER_RANGE))


def running_before(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str | None = None,
                   name: str = "before") -> DataFrame:
    """``df`` plus ``name``: the sum of ``value`` (1 if None) over the rows of the same ``keys`` that
    come earlier in ``order``. The order must tell the rows of a key apart; no keys: one order for
    all rows."""
    keys = list(keys)
    one = F.col(value) if value else F.lit(1)
    # The range bounds are drawn from a sample of the rows, which reads them once more.
    df, m = materialize(df, {"rows": F.count(F.lit(1))})
    spark = df.sparkSession
    # A range, and a task of the joins on it, holds about ROWS_PER_RANGE rows at any size.
    n = ranges_of(spark, m["rows"])
    with fixed_partitioning(spark, n):
        ranged, _ = materialize(df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
                                .withColumn(_PART, F.spark_partition_id()))
        sums = ranged.groupBy(*keys, _PART).agg(F.sum(one).alias("__fw_sum"))
        if keys:
            earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(
                Window.unboundedPreceding, -1)
            offsets = sums.select(*keys, _PART, F.coalesce(F.sum("__fw_sum").over(earlier), F.lit(0))
                                  .alias("__fw_offset"))
        else:                      # one number for each partition
            total, rows = 0, []
            for r in sorted(sums.collect()):
                rows.append((r[_PART], total))
                total += r["__fw_sum"]
            offsets = spark.createDataFrame(rows, f"{_PART} int, __fw_offset long")
        inside = Window.partitionBy(*keys, _PART).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, 0)
        own = ranged.withColumn("__fw_own", F.sum(one).over(inside) - one)
        placed, _ = materialize(own.join(offsets, [*keys, _PART]).select(
            *df.columns, (F.col("__fw_offset") + F.col("__fw_own")).cast("long").alias(name)))
    return placed


def member_chunks(members: DataFrame, key: str, value: str, order: str = "id",
                  size: int = 1000) -> DataFrame:
    """(key, chunk_no, members): the values of every key in the order of the distinct ``order``
    column, as lists of ``size`` (the last one may be shorter). A key of any size is many bounded
    rows; the lists in the order of ``chunk_no`` are the whole group."""
    placed = running_before(members.select(key, order, F.col(value).alias("__fw_value")), [key],
                            [F.col(order)], name="__fw_place")
    chunk = F.floor(F.col("__fw_place") / size).cast("long")
    listed = placed.groupBy(key, chunk.alias("chunk_no")).agg(
        F.array_sort(F.collect_list(F.struct("__fw_place", "__fw_value"))).alias("all"))
    return listed.select(key, "chunk_no", F.col("all.__fw_value").alias("members"))


def with_positions(ranked: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """``ranked`` plus its place, from 1, in ``order``, which must tell all rows apart."""
    return running_before(ranked, [], order, name="__fw_before").select(
        *ranked.columns, (F.col("__fw_before") + 1).alias(name))
