"""Fan sample against brute force; sinks (append, insert-if-absent, id lists)."""

import math
import random
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from fanweave.operators.neighborhood import absent_from, incident_edges
from fanweave.operators.sampling import fan_sample
from fanweave.sources.readers import read_follows, read_id_list, ALT_LAYOUT
from fanweave.sources.sinks import insert_if_absent, read_table, write_id_list, write_table


def brute_sample(edges, creators, fraction):
    out = []
    for c in creators:
        fans = sorted(s for s, d in edges if d == c)
        out += [(c, f) for f in fans[: math.floor(fraction * len(fans))]]
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_fan_sample_matches_brute_force(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        sample_equals_brute_force(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def sample_equals_brute_force(spark):
    rnd = random.Random(7)
    edges = []
    for _ in range(600):  # one hot creator (0) with a third of the edges, parallel edges included
        edges.append((rnd.randrange(1, 120), 0 if rnd.random() < 0.34 else rnd.randrange(1, 40)))
    df = spark.createDataFrame(edges, "src long, dst long")
    creators = sorted({d for _, d in edges})
    cdf = spark.createDataFrame([(c,) for c in creators], "id long")
    for fraction in (0.1, 0.35):
        got = sorted((r.creator, r.fan)
                     for r in fan_sample(df, cdf, fraction).collect())
        assert got == brute_sample(edges, creators, fraction)


def test_fan_sample_of_a_giant_creator(spark):
    fans = spark.range(1, 200_001).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
    few = spark.range(300_000, 300_010).select(F.col("id").alias("src"),
                                               F.lit(1).cast("long").alias("dst"))
    got = fan_sample(few.unionByName(fans).repartition(8),
                     spark.createDataFrame([(0,), (1,), (2,)], "id long"))
    assert got.where("creator = 0").agg(F.count("fan"), F.max("fan")).first()[:] == (20_000, 20_000)
    assert [r["fan"] for r in got.where("creator = 1").collect()] == [300_000]


def test_fan_sample_small_creator_is_empty(spark):
    df = spark.createDataFrame([(i, 5) for i in range(9)], "src long, dst long")
    assert fan_sample(df, spark.createDataFrame([(5,)], "id long")).count() == 0


def test_incident_edges_modes(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (3, 4), (1, 2)], "src long, dst long")
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    dedup = sorted(tuple(r) for r in incident_edges(edges, ids).collect())
    assert dedup == [(1, 1, "Directed"), (1, 2, "Directed"), (2, 1, "Directed")]
    raw = incident_edges(edges, ids, dedup=False).collect()
    # (1,2) twice in the data, found from both ends; (2,1) from both ends; self-loop twice.
    assert len(raw) == 2 * 2 + 2 + 2


def test_insert_if_absent_rerun_adds_nothing(spark):
    path = f"{tempfile.mkdtemp(dir='/tmp')}/community-{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(1, 2, "Directed"), (1, 2, "Directed"), (3, 4, "Directed")],
                                 "Source long, Target long, Type string")
    assert insert_if_absent(rows, path).count() == 2
    assert insert_if_absent(rows, path).count() == 0
    assert read_table(spark, path).count() == 2
    assert absent_from(rows, None).count() == 2


def test_append_sink_duplicates_on_rerun(spark):
    path = f"{tempfile.mkdtemp(dir='/tmp')}/topKFans-{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(1, "a", "b", 3)], "id long, name string, intro string, fans long")
    write_table(rows, path)
    write_table(rows, path)
    assert read_table(spark, path).count() == 2
    write_table(rows, path, mode="overwrite")
    assert read_table(spark, path).count() == 1


def test_id_list_roundtrip_and_alt_layout(spark):
    base = tempfile.mkdtemp(dir="/tmp")
    ids = spark.createDataFrame([(10 ** 11,), (5,), (5,)], "id long")
    write_id_list(ids, f"{base}/ids")
    back = sorted(r.id for r in read_id_list(spark, f"{base}/ids").collect())
    assert back == [5, 5, 10 ** 11]
    alt = spark.createDataFrame([("7", 8)], "soureId string, dstId long")
    alt.write.parquet(f"{base}/focus")
    e = read_follows(spark, f"{base}/focus", **ALT_LAYOUT).collect()
    assert [(r.src, r.dst, r.weight) for r in e] == [(7, 8, 1.0)]


def test_loop_partitions_follow_data_size(spark):
    from fanweave.session import LOOP_ROWS_PER_PARTITION, loop_partitions
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        lower = min(200, spark.sparkContext.defaultParallelism)
        assert loop_partitions(spark, 1000) == lower            # tiny: no 200 empty tasks
        assert loop_partitions(spark, 50 * LOOP_ROWS_PER_PARTITION) == max(lower, 50)
        assert loop_partitions(spark, 10 ** 12) == 10 ** 12 // LOOP_ROWS_PER_PARTITION  # no cap
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
