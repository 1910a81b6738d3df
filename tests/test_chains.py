"""Strongly connected components of long chains, cycles and random graphs."""

import random

import pytest

from fanweave.operators import components
from fanweave.operators.graph import assemble


def graph(spark, pairs):
    return assemble(spark.createDataFrame([], "id long, name string, intro string"),
                    spark.createDataFrame([(a, b, 1.0) for a, b in pairs],
                                          "src long, dst long, weight double"))


def plain_scc(pairs):
    """{id: smallest id of its component}, by reach in both directions."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())

    def reach(v):
        seen, todo = {v}, [v]
        while todo:
            for w in out[todo.pop()]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return seen

    reached = {v: reach(v) for v in out}
    return {v: min(w for w in reached[v] if v in reached[w]) for v in out}


def labels(spark, pairs):
    return {r["id"]: r["component"]
            for r in components.strongly_connected_components(graph(spark, pairs)).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_with_chains(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(25), rnd.randrange(25)) for _ in range(30)]
    free = 100
    for _ in range(12):                       # chains between, into, out of and around the rest
        a, b, n = rnd.randrange(25), rnd.randrange(25), rnd.randrange(1, 9)
        way = [a, *range(free, free + n), b]
        free += n
        kind = rnd.randrange(4)
        way = way[1:] if kind == 1 else way[:-1] if kind == 2 else [*way[1:-1], way[1]] \
            if kind == 3 else way
        pairs += list(zip(way, way[1:]))
    assert labels(spark, pairs) == plain_scc(pairs)


def test_long_cycle_and_path_take_few_rounds(spark, monkeypatch):
    n, made = 50_000, []
    real = components.materialize
    monkeypatch.setattr(components, "materialize",
                        lambda *a, **k: made.append(1) or real(*a, **k))
    cycle = [(i, (i + 1) % n) for i in range(n)]
    path = [(n + i, n + i + 1) for i in range(n)]
    got = labels(spark, cycle + path)
    assert all(got[i] == 0 for i in range(n)) and all(got[i] == i for i in range(n, 2 * n + 1))
    assert len(made) < 60                     # 2 x 17 doublings and a few more
