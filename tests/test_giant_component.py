"""Personalized PageRank of every user of a connected graph, in groups of bounded size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fanweave.functions.expr import RESET_PROB, TOLERANCE
from fanweave.operators import pagerank as module
from fanweave.operators.graph import assemble
from fanweave.plans import recommend as rc
from fanweave.plans.catalog import graph_of

SF = "/root/testdata/sf0.001"


def brute_force(edges: list[tuple[int, int]], ids: list[int]) -> np.ndarray:
    """Rank of every vertex (column) for every source (row), by whole matrices."""
    at = {v: i for i, v in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for s, t in edges:
        a[at[s], at[t]] += 1
    deg = a.sum(1)
    w = a / np.maximum(deg, 1)[:, None]
    rank = np.eye(len(ids))
    delta = np.eye(len(ids))
    while True:
        sent = np.where((delta > TOLERANCE) & (deg > 0), delta, 0.0)
        if not sent.any():
            return rank / rank.sum(1, keepdims=True)
        delta = (1 - RESET_PROB) * (sent @ w)
        rank += delta


def best(ranks: np.ndarray, ids: list[int]) -> dict:
    out = {}
    for i, v in enumerate(ids):
        others = [(-round(r, 9), u) for r, u in zip(ranks[i], ids) if u != v and r > 0]
        out[v] = min(others)[1] if others else None
    return out


@pytest.fixture(scope="module")
def full(spark):
    g = graph_of(spark, SF, "full")
    edges = [(r["src"], r["dst"]) for r in g.edges.select("src", "dst").collect()]
    ids = sorted(r["id"] for r in g.vertices.select("id").collect())
    return g, ids, brute_force(edges, ids)


@pytest.mark.parametrize("live", [None, 400_000])
def test_everyone_on_a_connected_graph(full, live):
    g, ids, ranks = full
    got = {r["id"]: r["recId"] for r in
           rc.personal_recommendations(g, live_messages=live).collect()}
    assert got == best(ranks, ids)


def test_groups_hold_the_bound_and_change_nothing(full, spark, monkeypatch):
    g, ids, ranks = full
    seen, real = [], module.materialize

    def spy(df, metrics=None):
        out, m = real(df, metrics)
        if metrics and "messages" in metrics:
            seen.append(df.columns)
        return out, m

    monkeypatch.setattr(module, "materialize", spy)
    some = spark.createDataFrame([(v,) for v in ids[:10]], "id long")
    got = {(r["source"], r["id"]): r["rank"] for r in module.personalized_pagerank(
        g, some, live_messages=20_000).collect()}
    assert len(seen) > 3                                    # several groups, one after the other
    at = {v: i for i, v in enumerate(ids)}
    expect = {(s, v): ranks[at[s], at[v]] for s in ids[:10] for v in ids if ranks[at[s], at[v]] > 0}
    assert got.keys() == expect.keys()
    for key, rank in got.items():
        assert rank == pytest.approx(expect[key], abs=1e-12)


def test_a_single_source_is_never_cut(spark):
    users = spark.range(1, 31).select("id", F.lit("n").alias("name"), F.lit("i").alias("intro"))
    follows = spark.createDataFrame([(1, v, 1.0) for v in range(2, 31)],
                                    "src long, dst long, weight double")
    got = module.personalized_pagerank(assemble(users, follows), spark.createDataFrame(
        [(1,)], "id long"), live_messages=1)
    assert got.count() == 30
