"""Rules that hold at any size: nothing is dropped silently, loops end only when they are done, order
is what the rankings promise, reruns of jobs do what they say."""

import pytest
from pyspark.sql import functions as F

from fanweave.operators.components import connected_components
from fanweave.operators.graph import assemble
from fanweave.operators.pagerank import links, personalized_pagerank
from fanweave.plans import jobs
from fanweave.plans import ranking as rk
from fanweave.plans import recommend as rc
from fanweave.sources.readers import follows_from, read_id_list
from tests.conftest import OFF

EDGE = "src long, dst long, weight double"
USER = "id long, name string, intro string"


def graph(spark, edges, users=()):
    return assemble(spark.createDataFrame(list(users), USER),
                    spark.createDataFrame([(a, b, 1.0) for a, b in edges], EDGE))


@pytest.mark.parametrize("edge", [(None, 2), (1, None)])
def test_null_endpoint_is_an_error(spark, edge):
    with pytest.raises(Exception, match="null in column"):
        graph(spark, [(1, 2), edge]).edges.collect()


def test_null_user_id_is_an_error(spark):
    with pytest.raises(Exception, match="null in column id"):
        graph(spark, [(1, 2)], [(None, "a", "b")]).vertices.collect()


def test_text_ids_are_read_and_bad_ones_are_errors(spark):
    good = spark.createDataFrame([("12345678901", "7")], "Source string, Target string")
    assert [tuple(r)[:2] for r in follows_from(good).collect()] == [(12345678901, 7)]
    bad = spark.createDataFrame([("x1", "7")], "Source string, Target string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|x1"):
        follows_from(bad).collect()


@pytest.mark.parametrize("line", ["", "  ", "12x"])
def test_bad_id_line_is_an_error(spark, tmp_path, line):
    spark.createDataFrame([("5",), (line,), ("6",)], "value string").coalesce(1).write.text(
        str(tmp_path / "ids"))
    with pytest.raises(Exception, match="not an id"):
        read_id_list(spark, str(tmp_path / "ids")).collect()


def test_rankings_come_in_order(hand_graph):
    for ranked, key in ((rk.fan_ranking(hand_graph), "fans"),
                        (rk.influence_ranking(hand_graph), "rank")):
        got = [(-round(r[key], 9), r["id"]) for r in ranked.collect()]
        assert got == sorted(got) and len({g[0] for g in got}) < len(got)   # there are ties


def test_weights_are_doubles_at_any_degree(spark):
    n = 30_000_000
    g = graph(spark, [(1, 2)])
    plan = links(g.materialize(), 2, 2 ** 62)[0]
    assert plan.schema["w"].dataType.simpleString() == "double"
    m, deg = 3, n + 1
    w = spark.range(1).select((F.lit(m).cast("double") * (F.lit(1.0) / F.lit(deg))).alias("w"))
    assert w.first()["w"] == pytest.approx(m / deg, rel=1e-15)


def test_components_of_a_path_and_a_giant_star(spark):
    path = [(i, i + 1) for i in range(3000)]
    star = spark.range(20_000).select(F.lit(10 ** 6).alias("src"),
                                      (F.col("id") + 10 ** 6 + 1).alias("dst"),
                                      F.lit(1.0).alias("weight"))
    g = assemble(spark.createDataFrame([], USER), spark.createDataFrame(
        [(a, b, 1.0) for a, b in path], EDGE).unionByName(star))
    got = {r["component"]: r["n"] for r in connected_components(g).groupBy("component").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert got == {0: 3001, 10 ** 6: 20_001}


def test_personalized_messages_are_combined_before_the_shuffle(spark, monkeypatch):
    from fanweave.operators import pagerank as module
    plans = []
    real = module.materialize

    def spy(df, metrics=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, metrics)

    monkeypatch.setattr(module, "materialize", spy)
    personalized_pagerank(graph(spark, [(1, 2), (2, 3), (3, 1)]))
    steps = [p for p in plans if "hashpartitioning(source" in p and "partial_sum" in p]
    assert steps
    for p in steps:
        below = p[p.index("hashpartitioning(source"):]
        assert "partial_sum" in below.split("Join")[0]


def test_everyone_gets_a_recommendation_row(hand_graph):
    got = {r["id"] - OFF: r["recId"] for r in rc.personal_recommendations(hand_graph).collect()}
    assert set(got) == set(range(1, 12)) and got[9] is None


def test_reruns(spark, hand_graph, tmp_path):
    store = str(tmp_path)
    g = hand_graph.materialize()
    n = jobs.top_k_up(g, store).count()
    creators = rk.top_creators(g, 2).select("id")
    star = sorted(map(tuple, jobs.top_up_fans(g, store, creators).collect()))
    assert jobs.top_k_up(g, store).count() == 2 * n                  # plain inserts double
    again = jobs.top_up_fans(g, store, creators)
    assert sorted(map(tuple, again.collect())) == sorted(star * 2)   # same star, inserted again
    edges = jobs.fans_of(g, store, creators).count()
    assert jobs.fans_of(g, store, creators).count() == edges         # nothing new
    with pytest.raises(ValueError, match="stored ranking"):
        jobs.top_up_fans(g, store + "/other", creators)
