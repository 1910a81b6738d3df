"""Shared plumbing of the training-data operators: table access, materialization, Arrow buffers."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanweave.session import ensure_checkpoint_dir, scratch_path  # noqa: F401


# Batches are large and short-lived; the system's allocator gives their memory back at once.
pa.set_memory_pool(pa.system_memory_pool())

_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def share_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it.
    On a cluster it comes with ``--py-files`` or the image, and the extra path does no harm."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_rows(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Write ``df`` to ``path`` and read what is there. The shuffles of this one execution are of
    no use once its result is written, so they go."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN_SHUFFLES)
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        spark.conf.set(_CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder of ``spark.checkpoint.dir`` and read it back.

    A lost executor then costs a re-read of files, not a re-run of the plan above."""
    return write_rows(df, scratch_path(df.sparkSession, name))


def discard(df: DataFrame, path: str) -> None:
    """Give the disk of a large intermediate table back: no later step may read ``path``."""
    df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)


def crc32_mod(id_col: Column, modulus: int) -> Column:
    """crc32(id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array plus row offsets (null: empty), without a copy of
    the text where Arrow allows it. Offsets start at 0."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def parts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive runs of rows, (first, end), of about ``most`` bytes together: a run is closed by
    the row that reaches the bound, so only a longer row makes a longer run."""
    out, first, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        total += n
        if total >= most:
            out.append((first, i + 1))
            first, total = i + 1, 0
    if first < len(sizes):
        out.append((first, len(sizes)))
    return out


def text_slices(column: pa.Array, chars: int) -> Iterator[tuple[int, list[str]]]:
    """A string column in runs of about ``chars`` characters: (first row, texts). Only the texts of
    one run are Python strings at a time."""
    first, run, size = 0, [], 0
    for at in range(0, len(column), 128):
        for t in texts(column.slice(at, 128)):
            run.append(t)
            size += len(t)
            if size >= chars:
                yield first, run
                first, run, size = first + len(run), [], 0
    if run:
        yield first, run


def texts(column: pa.Array) -> list[str]:
    """A string column as Python strings (null: empty)."""
    return ["" if t is None else t for t in column.to_pylist()]
