"""Superstep plumbing shared by the iterative algorithms.

Design (why the loops look the way they do):

* Each superstep reads its state **once** (state JOIN a static edge table,
  then one aggregation).  The plan therefore grows linearly, so several
  supersteps can share one Spark job; after ``steps_per_job`` supersteps the
  state is cut with a reliable ``checkpoint()`` into the session's shared
  checkpoint folder (executor loss never replays more than one job).
* The static edge table is checkpointed once, hash-partitioned on the join
  key, and the state leaves every superstep hash-partitioned on the same key
  with the same partition count, so the join needs no exchange: the only
  shuffle per superstep is the aggregation (with a map-side partial
  aggregate, so a celebrity vertex costs one row per map task).
* Adaptive execution is switched off while a loop runs: it would coalesce or
  re-plan the fixed co-partitioning and force the edge table to be
  re-shuffled in every superstep.  It is restored afterwards.
* Convergence counters ride along as ``Observation`` metrics of the
  checkpoint job, so no extra pass is needed.
* A job's shuffle files go when its rows are stored, and a loop deletes what it
  stored and reads no more (``release``): waiting for the driver's garbage
  collection, the disk would hold all supersteps of a large table.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from ..session import ensure_checkpoint_dir, scratch_path

_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, metrics: dict[str, Column] | None = None
                ) -> tuple[DataFrame, dict]:
    """Checkpoint ``df`` (eager, reliable) and return it with the observed ``metrics``."""
    ensure_checkpoint_dir(df.sparkSession)
    return _run_once(df, metrics, lambda once: once.checkpoint(eager=True))


def store_table(df: DataFrame, metrics: dict[str, Column] | None = None
                ) -> tuple[DataFrame, dict, str]:
    """Like ``materialize``, as compressed Parquet: a table of millions of narrow rows takes a small
    part of a checkpoint's disk, but forgets how it was partitioned. Returns its path as well."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "table")
    _, found = _run_once(df, metrics, lambda once: once.write.option(
        "compression", "zstd").parquet(path))
    return spark.read.schema(df.schema).parquet(path), found, path


def _run_once(df: DataFrame, metrics: dict[str, Column] | None, action) -> tuple[DataFrame, dict]:
    """``action`` over a plan of its own, whose shuffle files go when it has ended; ``df`` itself
    may run again."""
    obs = Observation()
    with _settings(df.sparkSession, {_CLEAN_SHUFFLES: "true"}):
        once = df.select("*") if not metrics else df.observe(
            obs, *[c.alias(name) for name, c in metrics.items()])
        out = action(once)
    return out, dict(obs.get) if metrics else {}


def release(*stored: DataFrame | str | None) -> None:
    """Delete the files of frames from ``materialize``, or paths from ``store_table``, that nothing
    reads any more. What is not stored itself is left alone."""
    spark = SparkSession.getActiveSession()
    for one in stored:
        path = _checkpoint_file(one) if isinstance(one, DataFrame) else one
        if path is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _checkpoint_file(df: DataFrame) -> str | None:
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return None
    file = plan.rdd().getCheckpointFile()
    return file.get() if file.isDefined() else None


def fixed_partitioning(spark: SparkSession, partitions: int | None = None):
    """Run a loop with adaptive execution off and (optionally) every shuffle
    at ``partitions`` partitions, so state and edge tables stay co-partitioned.
    Both settings are restored on exit."""
    keys = {"spark.sql.adaptive.enabled": "false"}
    if partitions is not None:
        keys["spark.sql.shuffle.partitions"] = str(partitions)
    return _settings(spark, keys)


@contextmanager
def _settings(spark: SparkSession, keys: dict[str, str]):
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def run_supersteps(state: DataFrame, step, metrics: dict[str, Column], done,
                   steps_per_job: int | Callable[[dict], int] = 4,
                   exact_steps: int | None = None) -> tuple[DataFrame, dict, int]:
    """Apply ``step`` until ``done(metrics)``, or, where the number of steps is
    what is asked for (label propagation), ``exact_steps`` times.

    ``step`` must be idempotent once converged (a converged state maps to
    itself), which lets several supersteps share a job: overshooting the
    convergence point inside a job changes nothing.  ``steps_per_job`` is a
    number or a function of the last observed metrics (e.g. an estimate of
    the supersteps still needed).  Returns the final (checkpointed) state,
    its metrics and the number of supersteps run.
    """
    state, m = materialize(state, metrics)
    steps = 0
    while not done(m) and (exact_steps is None or steps < exact_steps):
        batch = steps_per_job(m) if callable(steps_per_job) else steps_per_job
        batch = max(1, batch)
        if exact_steps is not None:
            batch = min(batch, exact_steps - steps)
        nxt = state
        for _ in range(batch):
            nxt = step(nxt)
        steps += batch
        state, m = materialize(nxt, metrics)
    return state, m, steps


def decay_batch(tol: float, factor: float, cap: int = 16) -> Callable[[dict], int]:
    """Supersteps per job for a contraction.  If the largest live delta shrinks
    by a rate r per superstep, about log(tol / max_delta) / log(r) supersteps
    remain; run that many (at most ``cap``) in the next job.  r starts at
    ``factor`` and is then measured from the last two jobs."""
    seen: list[tuple[float, int]] = []  # (max_delta, batch that produced it)
    last_batch = [0]

    def batch(m: dict) -> int:
        top = m.get("max_delta") or 0.0
        if top <= tol:
            return 1
        rate = factor
        if seen and last_batch[0] and 0 < top < seen[-1][0]:
            rate = min(0.99, max(0.05, (top / seen[-1][0]) ** (1.0 / last_batch[0])))
        seen.append((top, last_batch[0]))
        k = min(cap, max(1, math.ceil(math.log(tol / top) / math.log(rate))))
        last_batch[0] = k
        return k
    return batch
