"""Components kept up to date by micro-batches equal those of all edges at once."""

import random

import pytest

from fanweave.operators.components import connected_components
from fanweave.operators.graph import from_edges
from fanweave.sources.sinks import read_table
from fanweave.streaming import component_stream as cs


def plain(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {v: find(v) for v in root}


def labels(spark, store):
    return {r["id"]: r["component"] for r in cs.components(spark, store).collect()}


def test_five_micro_batches_and_a_restart(spark, tmp_path):
    rnd = random.Random(11)
    store, source = str(tmp_path / "store"), str(tmp_path / "follow")
    seen = []
    for batch in range(5):
        pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(12)]
        pairs += [(100 * batch + 1000 + i, 100 * batch + 1001 + i) for i in range(9)]
        pairs += [(1000 + 100 * (batch - 1), 1000 + 100 * batch)] if batch % 2 else [(7, 7)]
        seen += pairs
        spark.createDataFrame(pairs, "Source long, Target long").write.parquet(f"{source}/b{batch}")
        # A new query on the same checkpoint each time: the state is what is stored.
        stream = spark.readStream.schema("Source long, Target long").parquet(f"{source}/*")
        cs.watch_components(stream, store, str(tmp_path / "ckpt")).awaitTermination(120)
        assert labels(spark, store) == plain(seen)
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in seen], "src long, dst long, weight double")
    want = {r["id"]: r["component"] for r in connected_components(from_edges(edges)).collect()}
    assert labels(spark, store) == want
    links = read_table(spark, f"{store}/links")
    assert links.count() == links.select("id").distinct().count()


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    store = str(tmp_path)
    edges = spark.createDataFrame([(1, 2), (3, 2), (9, 9)], "src long, dst long")
    assert cs.components(spark, store).collect() == []
    for _ in range(2):
        cs.add_follows(edges, store, 0)
        assert labels(spark, store) == {1: 1, 2: 1, 3: 1, 9: 9}
        assert read_table(spark, f"{store}/links").count() == 2


def test_a_null_endpoint_is_an_error(spark, tmp_path):
    edges = spark.createDataFrame([(1, None)], "src long, dst long")
    with pytest.raises(Exception, match="null in column"):
        cs.add_follows(edges, str(tmp_path), 0)
