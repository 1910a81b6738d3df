"""Fan sample (O4/A7/F4): the first ``floor(fraction * n)`` fan edges of each
creator in follower-id order, n = the creator's number of fan edges.

The creator with the most fans is by definition the hottest key, so the
ordering is never done as one window over a creator's fans: fan edges are
pre-aggregated to (creator, fan, multiplicity), and ``placement.running_before``
gives every fan the number of the creator's fan edges before it, by ranges of
(creator, fan) of even size, whatever a creator's degree.

A fan is in the sample ``min(m, k - before)`` times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import FAN_SAMPLE_FRACTION, floor_fraction
from .iterate import materialize
from .placement import ranges_of, running_before


def fan_sample(edges: DataFrame, creators: DataFrame,
               fraction: float = FAN_SAMPLE_FRACTION) -> DataFrame:
    """(creator, fan) rows, one per sampled fan edge (a fan followed twice can appear twice)."""
    ids = creators.select(F.col("id").alias("dst")).distinct()
    # The edges' own plan ends here, and the counts are dealt by their number: a task holds the
    # same number of rows at any size, and no counts beside the sorts of a join.
    edges, m = materialize(edges.select("src", "dst"), {"rows": F.count(F.lit(1))})
    n = ranges_of(edges.sparkSession, m["rows"])
    fan = edges.join(ids, "dst", "left_semi").repartition(n, "dst", "src")
    counts = fan.groupBy("dst", "src").agg(F.count(F.lit(1)).alias("m"))
    placed = running_before(counts, ["dst"], [F.col("src")], "m")
    cut, _ = materialize(placed.groupBy("dst").agg(
        floor_fraction(F.sum("m"), fraction).alias("k")).where("k > 0"))
    take = F.least(F.col("m"), F.greatest(F.lit(0), F.col("k") - F.col("before")))
    chosen = placed.join(cut, "dst").select("dst", "src", take.alias("t")).where("t > 0")
    return chosen.select(F.col("dst").alias("creator"),
                         F.explode(F.array_repeat(F.col("src"), F.col("t").cast("int"))).alias("fan"))
