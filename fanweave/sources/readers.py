"""Readers for users, follow edges and id lists (any Spark data source).

The users/follow documents of the original store become ordinary tables; the
readers take ``format``/``options``: Parquet is the default, ``documents`` are
collections of JSON documents (``sources.documents``), and a document-store
connector can be plugged in where one is on the class path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import to_long, to_str
from . import documents

USER_COLUMNS = ("id", "name", "intro")
EDGE_COLUMNS = ("src", "dst", "weight")


def _load(spark: SparkSession, path: str, format: str, options: dict | None) -> DataFrame:
    if format == documents.FORMAT:
        documents.register(spark)
    reader = spark.read.format(format)
    if options:
        reader = reader.options(**options)
    return reader.load(path)


def users_from(df: DataFrame, id_col: str = "id", name_col: str = "name",
               intro_col: str = "intro") -> DataFrame:
    """User rows -> (id LONG, name STRING, intro STRING)."""
    return df.select(to_long(id_col, df.schema[id_col].dataType).alias("id"),
                     to_str(name_col).alias("name"), to_str(intro_col).alias("intro"))


def follows_from(df: DataFrame, src_col: str = "Source", dst_col: str = "Target") -> DataFrame:
    """Follow rows -> (src LONG, dst LONG, weight DOUBLE=1.0); parallel edges kept."""
    return df.select(to_long(src_col, df.schema[src_col].dataType).alias("src"),
                     to_long(dst_col, df.schema[dst_col].dataType).alias("dst"),
                     F.lit(1.0).alias("weight"))


def read_users(spark: SparkSession, path: str, format: str = "parquet",
               options: dict | None = None, **cols) -> DataFrame:
    """User scan."""
    return users_from(_load(spark, path, format, options), **cols)


def read_follows(spark: SparkSession, path: str, format: str = "parquet",
                 options: dict | None = None, src_col: str = "Source",
                 dst_col: str = "Target") -> DataFrame:
    """Follow scan; ``src_col``/``dst_col`` select the layout
    (``Source``/``Target`` or the alternate ``soureId``/``dstId``)."""
    return follows_from(_load(spark, path, format, options), src_col, dst_col)


ALT_LAYOUT = {"src_col": "soureId", "dst_col": "dstId"}


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """A text file with one id per line -> (id LONG). A blank line, like any other that is no
    number, is an error."""
    line = F.trim("value")
    bad = F.raise_error(F.concat(F.lit("not an id: '"), line, F.lit("'"))).cast("long")
    return spark.read.text(path).select(
        F.coalesce(line.try_cast("long"), bad).alias("id"))
