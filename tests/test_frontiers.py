"""Loops that send changes only give what whole rounds give."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fanweave.operators import components, labelprop, pagerank, placement
from tests.test_rules import graph


def whole_rounds(pairs, steps):
    hears = {}
    for a, b in pairs:
        hears.setdefault(a, []).append(b)
        hears.setdefault(b, []).append(a)
    label = {v: v for v in hears}
    for _ in range(steps):
        counts = {v: Counter(label[w] for w in near) for v, near in hears.items()}
        label = {v: min(c, key=lambda x: (-c[x], x)) for v, c in counts.items()}
    return label


@pytest.mark.parametrize("seed,steps,hot", [(2, 9, None), (6, 12, 3)])
def test_labels_are_counted_by_changes(spark, monkeypatch, seed, steps, hot):
    """A graph that settles beside a pair that swaps its labels for ever: the counts are kept,
    and each step changes them."""
    rnd = random.Random(seed)
    pairs = [(90, 91)] + [(rnd.randrange(12), rnd.randrange(12)) for _ in range(40)]
    pairs += [(20, 21), (21, 22), (22, 20), (20, 20), (22, 23), (23, 24), (24, 22)]
    made, real = [], labelprop.materialize
    monkeypatch.setattr(labelprop, "materialize",
                        lambda df, *a: made.append(df.columns) or real(df, *a))
    monkeypatch.setattr(labelprop, "LIST_SIZE", 2)
    got = {r["id"]: r["label"] for r in
           labelprop.label_propagation(graph(spark, pairs), steps, hot_degree=hot).collect()}
    assert got == whole_rounds(pairs, steps)
    assert made.count(["receiver", "label", "c"]) > 2


@pytest.mark.parametrize("low,high,packed", [(-7, 9, True), (-2 ** 62, 2 ** 62, False)])
def test_best_labels_are_hashed_where_count_and_label_fit_a_long(spark, low, high, packed):
    rows = [(1, low, 2), (1, high, 2), (1, 3, 1), (2, high, 5), (2, low, 4), (3, -1, 1), (3, 0, 1)]
    got = (spark.createDataFrame(rows, "receiver long, label long, c long").groupBy("receiver")
           .agg(F.expr(labelprop.best_label(5, low, high)).alias("new")))
    assert dict(got.collect()) == {1: low, 2: high, 3: -1}
    assert ("SortAggregate" in got._jdf.queryExecution().toString()) != packed


def test_only_changed_vertices_send_in_a_strong_component_step(spark):
    links = spark.createDataFrame([(1, 2, False), (1, 1, True), (2, 2, True)],
                                  "src long, dst long, self boolean")
    heard = spark.createDataFrame([(1, 1, False), (2, 2, True)], "id long, colour long, changed boolean")
    got = spark.sql(components._COLOUR_STEP, links=links, state=heard)
    assert sorted(map(tuple, got.collect())) == [(1, 1, False), (2, 2, False)]


def test_personalized_pairs_are_stored_once(spark, monkeypatch):
    """On a path each pair hears one message, so the supersteps store no pair twice."""
    n, stored, real = 9, [], pagerank.materialize

    def spy(df, metrics=None):
        out, m = real(df, metrics)
        if metrics and "messages" in metrics:
            stored.extend((r["source"], r["id"]) for r in out.collect())
        return out, m

    monkeypatch.setattr(pagerank, "materialize", spy)
    g = graph(spark, [(i, i + 1) for i in range(n)])
    got = pagerank.personalized_pagerank(g).count()
    assert got == (n + 1) * (n + 2) // 2 == len(stored) == len(set(stored))


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    """A range holds a bounded number of rows whatever the session's number of partitions."""
    monkeypatch.setattr(placement, "ROWS_PER_RANGE", 50)
    parts, real = [], placement.materialize

    def spy(df, metrics=None):
        out, m = real(df, metrics)
        if placement._PART in df.columns:
            parts.append(out.rdd.getNumPartitions())
        return out, m

    monkeypatch.setattr(placement, "materialize", spy)
    rows = spark.range(1000).select((F.col("id") % 2).alias("key"), "id")
    got = placement.running_before(rows, ["key"], [F.col("id")]).collect()
    assert parts == [20]
    assert all(r["before"] == r["id"] // 2 for r in got) and len(got) == 1000


def whole_pagerank(pairs, tol=1e-4, reset=0.15):
    ids = {v for pair in pairs for v in pair}
    deg = Counter(a for a, _ in pairs)
    rank, delta = dict.fromkeys(ids, reset), dict.fromkeys(ids, reset)
    while any(delta[a] > tol for a in deg):
        heard = Counter()
        for a, b in pairs:
            if delta[a] > tol:
                heard[b] += delta[a] / deg[a]
        delta = {v: (1 - reset) * heard[v] for v in ids}
        rank = {v: rank[v] + delta[v] for v in ids}
    return {v: r * len(ids) / sum(rank.values()) for v, r in rank.items()}


@pytest.mark.parametrize("hot", [None, 4])
def test_pagerank_reads_lists_of_receivers(spark, monkeypatch, hot):
    """The links that every superstep reads are a few rows per sender, not one per edge; parallel
    edges, self-loops, vertices that follow nobody and hot senders keep their share."""
    rnd = random.Random(8)
    pairs = [(rnd.randrange(10), rnd.randrange(14)) for _ in range(300)]
    pairs += [(20, 20), (20, 21), (21, 22), (23, 20), (23, 20)]
    rows, real = [], pagerank.materialize

    def spy(df, metrics=None):
        out, m = real(df, metrics)
        if "self" in out.columns:
            rows.extend(out.where("NOT self").collect())
        return out, m

    monkeypatch.setattr(pagerank, "materialize", spy)
    got = {r["id"]: r["rank"] for r in
           pagerank.pagerank(graph(spark, pairs), hot_degree=hot).collect()}
    assert got == pytest.approx(whole_pagerank(pairs), rel=1e-9)
    assert len(rows) < len(set(pairs)) / 2
