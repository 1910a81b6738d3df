"""Outcomes on the fixed hand graph, taken from the graph library the
original jobs called (see FIXTURES.md section 4)."""

import pytest
from pyspark.sql import functions as F

from conftest import OFF, by_id
from fanweave.operators.components import connected_components, strongly_connected_components
from fanweave.operators.degrees import in_degrees
from fanweave.operators.labelprop import label_propagation
from fanweave.operators.pagerank import best_other, pagerank, personalized_pagerank
from fanweave.plans.communities import community_census

PAGERANK = {1: 2.1138681427802597, 2: 0.8002716857391154, 3: 2.250219483830175,
            4: 0.20134237861804163, 5: 1.3415219973270553, 6: 0.20134237861804163,
            7: 0.5436244222687124, 8: 0.20134237861804163, 9: 0.6634231375464471,
            10: 1.3415219973270553, 11: 1.3415219973270553}


def test_fans(hand_graph):
    fans = by_id(in_degrees(hand_graph.edges, "fans"))
    assert fans == {1: 1, 2: 1, 3: 4, 5: 1, 7: 2, 9: 1, 10: 1, 11: 1}


def test_pagerank(hand_graph):
    ranks = by_id(pagerank(hand_graph))
    assert set(ranks) == set(PAGERANK)
    for k, v in PAGERANK.items():
        assert ranks[k] == pytest.approx(v, abs=1e-9)
    assert sum(ranks.values()) == pytest.approx(11.0, abs=1e-9)


@pytest.mark.parametrize("steps_per_job", [1, 3, 8])
def test_pagerank_steps_per_job_do_not_change_result(hand_graph, steps_per_job):
    ranks = by_id(pagerank(hand_graph, steps_per_job=steps_per_job))
    for k, v in PAGERANK.items():
        assert ranks[k] == pytest.approx(v, abs=1e-12)


@pytest.mark.parametrize("hot_degree", [0, 1])
def test_pagerank_hot_sources_split(hand_graph, hot_degree):
    """Out-degree above hot_degree moves a vertex's edges to the broadcast path."""
    ranks = by_id(pagerank(hand_graph, hot_degree=hot_degree))
    for k, v in PAGERANK.items():
        assert ranks[k] == pytest.approx(v, abs=1e-12)


def test_personalized_pagerank(hand_graph, spark):
    ppr = personalized_pagerank(hand_graph)
    rows = {(r.source - OFF, r.id - OFF): r.rank for r in ppr.collect()}
    expect = {(1, 1): 0.4783, (1, 2): 0.13552, (1, 3): 0.38618,
              (4, 1): 0.34552, (4, 2): 0.0979, (4, 3): 0.40652, (4, 4): 0.15006,
              (7, 7): 0.54054, (7, 9): 0.45946, (9, 9): 1.0, (5, 5): 1.0}
    for k, v in expect.items():
        assert rows[k] == pytest.approx(v, abs=1e-5)
    for s in range(1, 12):
        assert sum(v for (a, _), v in rows.items() if a == s) == pytest.approx(1.0, abs=1e-12)
    recs = {r.id - OFF: r.recId for r in best_other(ppr).collect()}
    assert recs[1] == recs[4] == 3 + OFF and recs[7] == 9 + OFF
    assert recs[9] is None and recs[5] is None  # nothing else reachable


def test_personalized_pagerank_batches(hand_graph):
    one = {(r.source, r.id): r.rank for r in personalized_pagerank(hand_graph).collect()}
    three = {(r.source, r.id): r.rank for r in personalized_pagerank(hand_graph, batches=3).collect()}
    assert one.keys() == three.keys()
    for k in one:
        assert one[k] == pytest.approx(three[k], abs=1e-12)


def test_connected_components(hand_graph):
    cc = by_id(connected_components(hand_graph), value="component")
    expect = {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6, 8: 6, 9: 6, 10: 10, 11: 10}
    assert {k: v - OFF for k, v in cc.items()} == expect


def test_census(hand_graph):
    census = {r.band: r.communities for r in community_census(hand_graph).collect()}
    assert census == {"1": 1, "2-4": 3, "5-9": 0, "10+": 0}


def test_strongly_connected_components(hand_graph):
    scc = by_id(strongly_connected_components(hand_graph), value="component")
    expect = {i: i for i in range(1, 12)}
    expect.update({1: 1, 2: 1, 3: 1, 10: 10, 11: 10})
    assert {k: v - OFF for k, v in scc.items()} == expect


def test_label_propagation_step_count_is_honoured(hand_graph):
    forty = by_id(label_propagation(hand_graph, 40), value="label")
    five = by_id(label_propagation(hand_graph, 5), value="label")
    assert (forty[10] - OFF, forty[11] - OFF) == (10, 11)
    assert (five[10] - OFF, five[11] - OFF) == (11, 10)
    assert forty[5] - OFF == 5  # self-loop only: hears itself


@pytest.mark.parametrize("hot_degree", [0, 1])
def test_label_propagation_hot_senders(spark, hot_degree):
    from fanweave.plans.catalog import graph_of
    g = graph_of(spark, "/root/testdata/sf0.001", "full")
    plain = by_id(label_propagation(g, 6), value="label", offset=0)
    split = by_id(label_propagation(g, 6, hot_degree=hot_degree), value="label", offset=0)
    assert plain == split


def test_assembly_defaults_and_duplicates(spark):
    from fanweave.operators.graph import assemble
    users = spark.createDataFrame(
        [(1, "b", "x"), (1, "a", "y"), (2, "c", "z"), (12, "lonely", "w")],
        "id long, name string, intro string")
    follows = spark.createDataFrame([(1, 2, 1.0), (2, 99, 1.0), (2, 99, 1.0)],
                                    "src long, dst long, weight double")
    g = assemble(users, follows)
    v = {r.id: (r.name, r.intro) for r in g.vertices.collect()}
    assert v == {1: ("a", "y"), 2: ("c", "z"), 12: ("lonely", "w"), 99: ("Unknown", "Unknown")}
    assert g.edges.count() == 3  # parallel edges kept
    assert by_id(in_degrees(g.edges, "fans"), offset=0) == {2: 1, 99: 2}
    ranks = by_id(pagerank(g), offset=0)
    assert set(ranks) == {1, 2, 12, 99}
    assert sum(ranks.values()) == pytest.approx(4.0)
    cc = by_id(connected_components(g), value="component", offset=0)
    assert cc == {1: 1, 2: 1, 99: 1, 12: 12}


def test_empty_graph(spark):
    from fanweave.operators.graph import assemble
    users = spark.createDataFrame([(1, "a", "b")], "id long, name string, intro string")
    follows = spark.createDataFrame([], "src long, dst long, weight double")
    g = assemble(users, follows)
    assert by_id(pagerank(g), offset=0) == {1: pytest.approx(1.0)}
    assert by_id(connected_components(g), value="component", offset=0) == {1: 1}
    assert by_id(label_propagation(g, 3), value="label", offset=0) == {1: 1}
    assert personalized_pagerank(g).where(F.col("id") != F.col("source")).count() == 0
