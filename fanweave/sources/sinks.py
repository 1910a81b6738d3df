"""Sinks (K1-K8): result tables written through any Spark data source.

The original jobs inserted documents one by one from the driver; here every
sink is one distributed write.  ``append`` reproduces the plain inserts (a
rerun duplicates rows); ``insert_if_absent`` reproduces the
find-then-insert pattern as distinct + anti-join against what is stored.

``insert_into_buckets`` does the same on a collection whose folders are buckets of the key: it reads
only the buckets that the new rows fall into.  What is visible after a crash is a part of the new
rows at most, and the rerun adds the rest: each key is stored once, however often a run is repeated.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iterate import materialize
from ..operators.neighborhood import RESULT_EDGE_COLUMNS, absent_from
from ..session import ensure_checkpoint_dir
from . import documents


def write_table(df: DataFrame, path: str, mode: str = "append", format: str = "parquet",
                options: dict | None = None) -> None:
    """K1-K4, K7: write rows (``append`` like the original inserts, or ``overwrite``)."""
    if format == documents.FORMAT:
        documents.register(df.sparkSession)
    writer = df.write.mode(mode).format(format)
    if options:
        writer = writer.options(**options)
    writer.save(path)


# The folder column of a collection in buckets, and where its number of buckets is kept.
BUCKET = "__fw_bucket"
_LAYOUT = "_layout"
BUCKETS = 256


def _load(spark: SparkSession, path: str, format: str, options: dict | None) -> DataFrame | None:
    if format == documents.FORMAT:
        documents.register(spark)
        last = documents.last_number(path)
        if last is None:
            return None
        # As for files, a frame shows what was stored when it was read, not what is written later.
        options = {"upTo": str(last), **(options or {})}
    try:
        return spark.read.format(format).options(**(options or {})).load(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND",
                                "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_table(spark: SparkSession, path: str, format: str = "parquet",
               options: dict | None = None) -> DataFrame | None:
    """The stored rows, or None where nothing is stored yet."""
    stored = _load(spark, path, format, options)
    if stored is None and format == "parquet":
        layout = _load(spark, f"{path}/{_LAYOUT}", "parquet", None)
        if layout is not None:                     # a collection in buckets without a row
            return spark.createDataFrame([], layout.first()["schema"])
    return stored if stored is None else stored.drop(BUCKET)


def insert_if_absent(df: DataFrame, path: str, keys: tuple[str, ...] = RESULT_EDGE_COLUMNS,
                     format: str = "parquet", options: dict | None = None) -> DataFrame:
    """K5/K6: append the rows whose key is not stored yet; returns what was added.

    The new rows are computed against the current table, checkpointed (so the
    write does not re-read a table it is appending to) and appended.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    existing = read_table(spark, path, format, options)
    fresh = absent_from(df, existing, keys).checkpoint(eager=True)
    write_table(fresh, path, "append", format, options)
    return fresh


def _buckets(df: DataFrame, path: str, keys: tuple[str, ...], buckets: int) -> int:
    """The number of buckets that a collection was made with; it is written on the first insert."""
    spark = df.sparkSession
    layout = _load(spark, f"{path}/{_LAYOUT}", "parquet", None)
    if layout is None:
        columns = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
        spark.createDataFrame([(",".join(keys), buckets, columns)],
                              "keys string, buckets int, schema string").coalesce(
            1).write.mode("overwrite").parquet(f"{path}/{_LAYOUT}")
        return buckets
    row = layout.first()
    if row["keys"] != ",".join(keys):
        raise ValueError(f"the collection at {path} has the key ({row['keys']})")
    return row["buckets"]


def absent_from_buckets(df: DataFrame, path: str, keys: tuple[str, ...] = RESULT_EDGE_COLUMNS,
                        buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``df``, each key once, whose key the collection at ``path`` does not hold, with
    their bucket. The batch's own bucket numbers (at most ``buckets``) prune the folders to read."""
    spark = df.sparkSession
    n = _buckets(df, path, keys, buckets)
    new, _ = materialize(df.dropDuplicates(list(keys)).withColumn(
        BUCKET, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")))
    touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())
    stored = _load(spark, path, "parquet", None)
    if stored is None or not touched:
        return new
    old = stored.where(F.col(BUCKET).isin(touched)).select(BUCKET, *keys)
    return new.join(old, [BUCKET, *keys], "left_anti").select(*new.columns)


def insert_into_buckets(df: DataFrame, path: str, keys: tuple[str, ...] = RESULT_EDGE_COLUMNS,
                        buckets: int = BUCKETS) -> DataFrame:
    """K5/K6: append the rows whose key is not stored yet; returns what was added. Keys must not be
    null. One writer at a time, as for any insert-if-absent without transactions."""
    fresh, _ = materialize(absent_from_buckets(df, path, keys, buckets))
    fresh.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(path)
    return fresh.drop(BUCKET)


def stored_rows(keys_wanted: DataFrame, path: str, keys: tuple[str, ...]) -> DataFrame | None:
    """The stored rows whose key is among ``keys_wanted``, from the buckets of those keys only; None
    where nothing is stored yet."""
    spark = keys_wanted.sparkSession
    stored = _load(spark, path, "parquet", None)
    if stored is None:
        return None
    n = _buckets(keys_wanted, path, keys, BUCKETS)
    wanted, _ = materialize(keys_wanted.select(*keys).distinct().withColumn(
        BUCKET, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")))
    touched = sorted(r[0] for r in wanted.select(BUCKET).distinct().collect())
    return stored.where(F.col(BUCKET).isin(touched)).join(
        wanted, [BUCKET, *keys], "left_semi").drop(BUCKET)


def write_id_list(ids: DataFrame, path: str, column: str = "id") -> None:
    """K8: one id per line of text."""
    ids.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)
