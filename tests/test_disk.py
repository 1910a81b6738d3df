"""What a loop holds on disk is what it reads on: no step before the last, no shuffle that has been read."""

import os
import random
import time
from collections import Counter

import pytest

from fanweave.operators import labelprop, pagerank
from fanweave.operators.iterate import materialize
from fanweave.plans import communities
from tests.test_frontiers import whole_pagerank, whole_rounds
from tests.test_rules import graph


def stored(spark):
    """The checkpoints and tables that lie in the checkpoint folder."""
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {f"{top}/{x}" for x in os.listdir(top) if x.startswith(("rdd-", "table-"))}


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {x for x in names if x.startswith("shuffle_") and x.endswith(".data")}


def new_shuffles(spark, before):
    """Files of shuffles that are not in ``before``; Spark deletes them in the background."""
    for _ in range(50):
        if shuffle_files(spark) <= before:
            return 0
        time.sleep(0.1)
    return len(shuffle_files(spark) - before)


def watched(spark, monkeypatch, module):
    """Tables and shuffles beyond those of now, counted whenever ``module`` has stored a table."""
    tables, shuffles, seen, real = stored(spark), shuffle_files(spark), [], module.materialize

    def spy(df, *a):
        out = real(df, *a)
        seen.append((out[0].columns, len(stored(spark) - tables), new_shuffles(spark, shuffles)))
        return out

    monkeypatch.setattr(module, "materialize", spy)
    return seen, tables


def test_a_stored_frame_needs_no_shuffle_and_the_plan_runs_again(spark):
    df = spark.range(100).repartition(3, "id")
    before = shuffle_files(spark)
    out, _ = materialize(df)
    assert new_shuffles(spark, before) == 0
    assert out.count() == df.count() == 100


@pytest.mark.parametrize("hot,most", [(None, 5), (3, 7)])
def test_labels_of_earlier_steps_are_not_kept(spark, monkeypatch, hot, most):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(30), 30 + rnd.randrange(30)) for _ in range(90)]     # swaps labels for ever
    g = graph(spark, pairs)
    seen, tables = watched(spark, monkeypatch, labelprop)
    got = labelprop.label_propagation(g, 12, hot_degree=hot)
    assert max(n for _, n, _ in seen) <= most
    assert {n for _, _, n in seen} == {0}
    assert len(stored(spark) - tables) == 1                   # the result
    assert {r["id"]: r["label"] for r in got.collect()} == whole_rounds(pairs, 12)


def test_large_label_groups_leave_the_labels_only(spark):
    rnd, tables = random.Random(7), stored(spark)
    pairs = [(c + rnd.randrange(15), c + rnd.randrange(15)) for c in (0, 100, 200) for _ in range(90)]
    pairs += [(300, 301), (301, 302)]
    got = communities.lpa_communities(communities.lpa_labels(graph(spark, pairs)))
    sizes = Counter(whole_rounds(pairs, 40).values())
    assert dict(map(tuple, got.collect())) == {k: n for k, n in sizes.items() if n > 10}
    assert len(stored(spark) - tables) == 1


@pytest.mark.parametrize("first,apart", [(-3, 1), (-2 ** 40, 10 ** 6), (-2 ** 62, 2 ** 55)])
def test_ids_of_any_width(spark, first, apart):
    """Four bytes or eight in a list, one long or two across the shuffle."""
    rnd = random.Random(9)
    pairs = [tuple(first + apart * rnd.randrange(60) for _ in range(2)) for _ in range(120)]
    pairs += pairs[:7]
    got = labelprop.label_propagation(graph(spark, pairs), 5)
    assert {r["id"]: r["label"] for r in got.collect()} == whole_rounds(pairs, 5)


def test_a_step_shuffles_its_messages_once_as_one_long(spark, monkeypatch):
    plans, real = [], labelprop.materialize

    def spy(df, *a):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *a)

    monkeypatch.setattr(labelprop, "materialize", spy)
    labelprop.label_propagation(graph(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)]), 2)
    last = [p for p in plans if "both" in p][-1]
    assert last.count("Exchange") == last.count("Exchange hashpartitioning(((both") == 1


@pytest.mark.parametrize("apart,hot", [(1, None), (1, 6), (2 ** 33, None)])
def test_pagerank_holds_one_job_and_few_increments(spark, monkeypatch, apart, hot):
    """A job of one superstep where more would send too many messages; increments are summed up."""
    rnd = random.Random(3)
    pairs = [(apart * rnd.randrange(20), apart * rnd.randrange(25)) for _ in range(120)]
    monkeypatch.setattr(pagerank, "JOB_MESSAGES", 150)
    monkeypatch.setattr(pagerank, "MOST_INCREMENTS", 3)
    monkeypatch.setattr(pagerank, "decay_batch", lambda tol, d, cap=16: cap)
    seen, tables = watched(spark, monkeypatch, pagerank)
    got = pagerank.pagerank(graph(spark, pairs), hot_degree=hot)
    supersteps = [c for c, _, _ in seen if c == ["id", "delta", "acc"]]
    assert len(supersteps) > 12
    assert seen[-1][0] == ["id", "rank"] and max(n for _, n, _ in seen) <= (10 if hot is None else 12)
    assert {n for _, _, n in seen} == {0}
    assert len(stored(spark) - tables) == 1                   # the ranks
    assert {r["id"]: r["rank"] for r in got.collect()} == pytest.approx(whole_pagerank(pairs), rel=1e-9)


def test_stored_edges_are_smaller_than_a_checkpoint(spark):
    tables, rows = stored(spark), 200_000
    g = graph(spark, [(1, 2)])
    from dataclasses import replace
    wide = spark.range(rows).selectExpr("id % 997 AS src", "xxhash64(id) % 20000 AS dst", "1.0D AS weight")
    g = replace(g, edges=wide).materialize()
    new = [x for x in stored(spark) - tables if "/table-" in x]
    size = sum(os.path.getsize(f"{new[0]}/{f}") for f in os.listdir(new[0]))
    assert len(new) == 1 and size < 8 * rows
    assert sorted(map(tuple, g.edges.collect())) == sorted(map(tuple, wide.collect()))
