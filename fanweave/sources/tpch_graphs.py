"""Follower graphs derived from every row of the TPC-H-style test tables.

full    users  = customer (c_custkey -> id, c_name -> name, c_mktsegment -> intro)
        follow = lineitem JOIN orders: the ordering customer follows the part key.
        Part keys share the id space and run past the customers, so some targets
        have no user row (they become "Unknown" vertices). Dense, one giant component.
orders  users  = orders (o_orderkey -> id, o_orderpriority -> name, o_orderstatus -> intro)
        follow = each order follows the same customer's next order, by date and key.
        Naturally fragmented: one chain per customer.

No row is left out. Only the needed columns are read; the lineitem-orders join
and the window both shuffle on a key of many small groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("full", "orders")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def users_table(spark: SparkSession, sf_dir: str, kind: str = "full") -> DataFrame:
    """The users collection: id, name, intro."""
    if kind == "orders":
        return table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"),
            F.col("o_orderstatus").alias("intro"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("intro"))


def follow_table(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The follow collection for graph ``kind``: Source, Target."""
    orders = table(spark, sf_dir, "orders")
    if kind == "orders":
        line = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        return (orders.select(F.col("o_orderkey").alias("Source"),
                              F.lead("o_orderkey").over(line).alias("Target"))
                .where("Target IS NOT NULL"))
    if kind != "full":
        raise ValueError(f"no graph {kind!r}; there are {KINDS}")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = orders.select("o_orderkey", "o_custkey")
    return (line.join(orders, line.l_orderkey == orders.o_orderkey)
            .select(F.col("o_custkey").alias("Source"), F.col("l_partkey").alias("Target")))


def users_sql(kind: str) -> str:
    if kind == "orders":
        return "SELECT o_orderkey AS id, o_orderpriority AS name, o_orderstatus AS intro FROM orders"
    return "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS intro FROM customer"


def follow_sql(kind: str) -> str:
    if kind == "orders":
        return ("SELECT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER "
                "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) "
                "WHERE dst IS NOT NULL")
    return ("SELECT o.o_custkey AS src, l.l_partkey AS dst FROM lineitem l "
            "JOIN orders o ON l.l_orderkey = o.o_orderkey")
