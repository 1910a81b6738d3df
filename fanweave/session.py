"""Session helpers: a sane local session for tests/bench and the checkpoint folder.

Iterative graph algorithms cut their lineage with reliable ``checkpoint()``.
On a cluster the shared folder comes from ``spark.checkpoint.dir``; we only
invent one (under /tmp) when the session runs in local mode and none is set.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "fanweave", extra: dict | None = None) -> SparkSession:
    """A local session configured the way the tests and ``bench.py`` expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("FANWEAVE_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, configuring it if needed.

    Order: an already-set folder, then ``spark.checkpoint.dir`` from the
    session/conf.  Only a local-mode session may fall back to a private
    folder under /tmp; a cluster without a shared folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # pragma: no cover - conf lookup differences
            configured = None
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: iterative operators need a shared "
                "folder that every executor and the driver can reach")
        configured = tempfile.mkdtemp(prefix="fanweave-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path inside the shared checkpoint folder (for round-trips)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Rows per partition the iterative loops aim for (at least the
# session's default parallelism).
LOOP_ROWS_PER_PARTITION = 2_000_000


def loop_partitions(spark: SparkSession, n_rows: int) -> int:
    """Partition count for a superstep loop over ``n_rows`` edge rows.

    Adaptive execution is off inside the loops (it would break their fixed
    co-partitioning), so tiny inputs must not be spread over hundreds of
    near-empty tasks. There is no upper bound: a partition holds at most about
    LOOP_ROWS_PER_PARTITION rows at any size."""
    lower = max(1, min(shuffle_partitions(spark), spark.sparkContext.defaultParallelism))
    return max(lower, -(-max(0, n_rows) // LOOP_ROWS_PER_PARTITION))
