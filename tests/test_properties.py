"""Invariants on a derived graph (sf0.001 'mid')."""

import os

import pytest
from pyspark.sql import functions as F

from fanweave.operators.components import connected_components, strongly_connected_components
from fanweave.operators.degrees import in_degrees
from fanweave.operators.pagerank import pagerank
from fanweave.plans.catalog import graph_of
from fanweave.plans.communities import community_census, community_sizes

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")


@pytest.fixture(scope="module")
def mid(spark):
    return graph_of(spark, SF, "full").persist()


def test_fans_sum_to_edges(mid):
    assert in_degrees(mid.edges).agg(F.sum("fans")).first()[0] == mid.edges.count()


def test_pagerank_sums_to_vertex_count(mid):
    n = mid.vertices.count()
    assert pagerank(mid).agg(F.sum("rank")).first()[0] == pytest.approx(n, rel=1e-9)


def test_components_partition_vertices(mid):
    labels = connected_components(mid)
    n = mid.vertices.count()
    assert community_sizes(labels).agg(F.sum("size")).first()[0] == n
    census = community_census(mid, labels).agg(F.sum("communities")).first()[0]
    assert census == labels.select("component").distinct().count()
    lab = labels.select(F.col("id").alias("x"), F.col("component").alias("c"))
    e = (mid.edges.join(lab.withColumnRenamed("x", "src").withColumnRenamed("c", "cs"), "src")
         .join(lab.withColumnRenamed("x", "dst").withColumnRenamed("c", "cd"), "dst"))
    assert e.where("cs <> cd").count() == 0
    # the label is the smallest id of the component
    mins = labels.groupBy("component").agg(F.min("id").alias("m"))
    assert mins.where("m <> component").count() == 0


def test_scc_refines_cc(mid):
    cc = connected_components(mid).withColumnRenamed("component", "cc")
    scc = strongly_connected_components(mid).withColumnRenamed("component", "scc")
    both = cc.join(scc, "id")
    assert both.groupBy("scc").agg(F.countDistinct("cc").alias("k")).where("k > 1").count() == 0


def test_partition_count_does_not_change_results(spark, mid):
    before = {r.id: r.rank for r in pagerank(mid).collect()}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        after = {r.id: r.rank for r in pagerank(mid).collect()}
        cc3 = {r.id: r.component for r in connected_components(mid).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert before.keys() == after.keys()
    for k in before:
        assert before[k] == pytest.approx(after[k], abs=1e-12)
    assert cc3 == {r.id: r.component for r in connected_components(mid).collect()}
