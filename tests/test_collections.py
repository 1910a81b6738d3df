"""Stored collections: documents, key buckets, edges by either end, drawings, places, member lists."""

import json
import os
import random
import time
import xml.etree.ElementTree as ET
from collections import defaultdict
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanweave.operators.components import connected_components
from fanweave.operators.neighborhood import incident_edges
from fanweave.operators.placement import member_chunks, running_before, with_positions
from fanweave.plans import communities as cm
from fanweave.plans import jobs
from fanweave.plans import networks as nw
from fanweave.plans import ranking as rk
from fanweave.sources import documents, edge_index, graphml
from fanweave.sources.readers import read_follows, read_users
from fanweave.sources.sinks import (BUCKET, absent_from_buckets, insert_into_buckets, read_table,
                                    write_table)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def above_scan(plan, mark):
    """The nodes from the scan that is marked so up to the next join."""
    lines = plan.split("\n")
    at = [i for i, x in enumerate(lines) if "FileScan" in x and mark in x][0]
    depth = lambda x: len(x) - len(x.lstrip(" :+-*("))
    found, least = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < least:
            least = depth(x)
            found.append(x)
            if "Join" in x:
                break
    return found


# --- documents

ROWS = [(1, "a", 0.5, True), (2, None, None, None), (3, 'qu"o\nte   é😀', -1e300, False)]
SCHEMA = "id long, name string, score double, ok boolean"


def test_documents_round_trip(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.createDataFrame(ROWS * 200, SCHEMA).repartition(5)
    write_table(df, path, "append", documents.FORMAT)
    write_table(df.limit(0), path, "append", documents.FORMAT)
    assert tuples(read_table(spark, path, documents.FORMAT)) == sorted(ROWS * 200, key=repr)
    small = read_table(spark, path, documents.FORMAT, {"splitBytes": "997"})
    assert small.rdd.getNumPartitions() > 10
    assert tuples(small) == sorted(ROWS * 200, key=repr)
    write_table(df.limit(1), path, "append", documents.FORMAT)
    assert read_table(spark, path, documents.FORMAT).count() == 601
    write_table(df.where("id = 2"), path, "overwrite", documents.FORMAT)
    assert tuples(read_table(spark, path, documents.FORMAT)) == [ROWS[1]] * 200


def test_a_field_too_few_or_too_many(spark, tmp_path):
    path = str(tmp_path / "c")
    write_table(spark.createDataFrame(ROWS, SCHEMA), path, "append", documents.FORMAT)
    own = spark.read.format(documents.FORMAT).schema("extra string, id long").load(path)
    assert tuples(own) == [(None, 1), (None, 2), (None, 3)]


def test_documents_refuse_what_they_cannot_hold(spark, tmp_path):
    path = str(tmp_path / "c")
    with pytest.raises(Exception, match="hold no array"):
        write_table(spark.createDataFrame([(1, [2])], "id long, a array<long>"), path, "append",
                    documents.FORMAT)
    with pytest.raises(Exception, match="non-finite"):
        write_table(spark.createDataFrame([(float("nan"),)], "x double"), path, "append",
                    documents.FORMAT)
    assert read_table(spark, path, documents.FORMAT) is None


def test_a_batch_of_documents_is_written_at_once(monkeypatch, tmp_path):
    rows = [{"id": i, "name": None if i % 3 else f"é{i}", "rank": i / 4} for i in range(1000)]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
                           T.StructField("rank", T.DoubleType())])
    writes, real = [], documents._open

    class Counting:
        def __init__(self, stream):
            self.stream = stream

        def write(self, text):
            writes.append(text)
            return self.stream.write(text)

        def close(self):
            self.stream.close()

    def opened(path):
        fs, base = real(path)
        return SimpleNamespace(create_dir=fs.create_dir, open_output_stream=lambda name: Counting(
            fs.open_output_stream(name))), base

    monkeypatch.setattr(documents, "_open", opened)
    monkeypatch.setattr(documents, "TaskContext", SimpleNamespace(
        get=lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 0)))
    batch = pa.RecordBatch.from_pylist(rows, schema=documents._arrow_schema(schema))
    done = documents.DocumentWriter(str(tmp_path / "c"), schema, False).write(
        iter([batch, batch.slice(0, 0), batch.slice(0, 1)]))
    assert done.rows == 1001 and len(writes) == 2
    with open(tmp_path / "c" / done.file, encoding="utf-8") as f:
        found = [json.loads(line) for line in f]
    assert found == [{k: v for k, v in r.items() if v is not None} for r in [*rows, rows[0]]]


def test_a_failed_write_leaves_the_collection_as_it_was(spark, tmp_path):
    path = str(tmp_path / "c")
    write_table(spark.createDataFrame(ROWS, SCHEMA), path, "append", documents.FORMAT)
    files = {f for _, _, names in os.walk(path) for f in names if f.endswith("jsonl")}
    broken = spark.range(0, 40_000, 1, 8).select(
        "id", F.when(F.col("id") == 39_999, F.raise_error(F.lit("broken document")))
        .otherwise(F.lit("x")).alias("name"), F.lit(1.0).alias("score"), F.lit(True).alias("ok"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken document"):
            write_table(broken, path, mode, documents.FORMAT)
        assert tuples(read_table(spark, path, documents.FORMAT)) == sorted(ROWS, key=repr)
    # Files that no manifest names, as a killed driver leaves them, are not read either.
    stray = tmp_path / "c" / "data" / "killed"
    stray.mkdir()
    (stray / "part-000000-1.jsonl").write_text(json.dumps({"id": 9}) + "\n")
    assert read_table(spark, path, documents.FORMAT).count() == len(ROWS)
    time.sleep(2)                                  # tasks that were being killed
    assert documents.vacuum(path) == 0             # too young
    assert documents.vacuum(path, -1) >= 1
    assert {f for _, _, names in os.walk(path) for f in names if f.endswith("jsonl")} == files
    assert tuples(read_table(spark, path, documents.FORMAT)) == sorted(ROWS, key=repr)


def test_readers_take_documents(spark, tmp_path):
    base = str(tmp_path)
    users = spark.createDataFrame([(10 ** 11, "u", "i"), (2, None, "j")],
                                  "id long, name string, intro string")
    follows = spark.createDataFrame([(10 ** 11, 2), (2, 2)], "soureId long, dstId long")
    write_table(users, f"{base}/users", "append", documents.FORMAT)
    write_table(follows, f"{base}/focus", "append", documents.FORMAT)
    assert tuples(read_users(spark, f"{base}/users", documents.FORMAT)) == tuples(users)
    got = read_follows(spark, f"{base}/focus", documents.FORMAT, src_col="soureId", dst_col="dstId")
    assert sorted(tuples(got)) == [(2, 2, 1.0), (10 ** 11, 2, 1.0)]


def test_every_job_runs_on_documents(spark, hand_graph, tmp_path):
    g = hand_graph.materialize()
    creators = rk.top_creators(g, 2).select("id")
    labels = connected_components(g)
    found = {}
    for format in ("parquet", documents.FORMAT):
        store = str(tmp_path / format)
        found[format] = [tuples(df) for df in (
            jobs.top_k_fans(g, store, format=format), jobs.top_k_up(g, store, format=format),
            jobs.top_k_up(g, store, format=format), jobs.personal_rec(g, store, format=format),
            jobs.top_up_fans(g, store, creators, format), jobs.fans_of(g, store, creators, format),
            jobs.fans_of(g, store, creators, format), jobs.community(g, store, labels, format),
            jobs.community_edges_of(g, store, creators, format))]
    assert found["parquet"] == found[documents.FORMAT]


# --- key buckets

EDGE = "Source long, Target long, Type string"


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "Directed") for a, b in pairs], EDGE)


def test_an_insert_reads_the_buckets_of_its_own_keys_only(spark, tmp_path):
    path = str(tmp_path / "community")
    first = edges_of(spark, [(i, i + 1) for i in range(500)] * 2)
    assert insert_into_buckets(first, path, buckets=32).count() == 500
    assert insert_into_buckets(first, path, buckets=8).count() == 0        # made with 32
    assert len([d for d in os.listdir(path) if d.startswith(BUCKET)]) == 32
    one = edges_of(spark, [(3, 4), (3, 4), (1000, 1)])
    plan = plan_of(absent_from_buckets(one, path))
    touched = {r[0] for r in one.select(F.pmod(F.xxhash64(*one.columns), F.lit(32))).collect()}
    scan = [x for x in plan.split("\n") if "FileScan" in x][0]
    assert f"PartitionFilters: [{BUCKET}" in scan.replace("isnotnull", "").replace("#", " #") \
        or BUCKET in scan.split("PartitionFilters:")[1].split("]")[0]
    assert all(str(b) in scan.split("PartitionFilters:")[1] for b in touched)
    assert tuples(insert_into_buckets(one, path)) == [(1000, 1, "Directed")]
    assert read_table(spark, path).count() == 501
    assert read_table(spark, path).columns == ["Source", "Target", "Type"]
    with pytest.raises(ValueError, match="has the key"):
        insert_into_buckets(one, path, keys=("Source",))


def test_a_rerun_after_a_crash_completes_the_insert(spark, tmp_path):
    """Files of some buckets only are visible, as after a crash while files were moved."""
    path = str(tmp_path / "c")
    rows = edges_of(spark, [(i, i) for i in range(300)])
    insert_into_buckets(rows, path, buckets=4)
    lost = [d for d in sorted(os.listdir(path)) if d.startswith(BUCKET)][0]
    for f in os.listdir(f"{path}/{lost}"):
        os.remove(f"{path}/{lost}/{f}")
    spark.catalog.refreshByPath(path)
    again = insert_into_buckets(rows, path, buckets=4)
    assert 0 < again.count() < 300
    assert tuples(read_table(spark, path)) == tuples(rows)


def test_the_community_job_twice(spark, tmp_path):
    chain = [(i, i + 1, 1.0) for i in range(1, 12)] + [(100 + i, 101 + i, 1.0) for i in range(30)]
    from fanweave.operators.graph import assemble
    g = assemble(spark.createDataFrame([], "id long, name string, intro string"),
                 spark.createDataFrame(chain, "src long, dst long, weight double")).materialize()
    want = [(a, b, "Directed") for a, b, _ in chain[:11]]
    for _ in range(2):
        assert tuples(jobs.community(g, str(tmp_path))) == sorted(want, key=repr)


# --- edges by either end

def test_lookups_leave_the_edges_where_they_are(spark, tmp_path):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(200), 0 if rnd.random() < 0.3 else rnd.randrange(200))
             for _ in range(3000)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    index = edge_index.write_index(edges, str(tmp_path / "i"), "lookup_test", 8)
    members = spark.createDataFrame([(0,), (7,), (7,), (999,)], "id long")
    for dedup in (True, False):
        got = edge_index.lookup_edges(index, members, dedup)
        assert tuples(got) == tuples(incident_edges(edges, members, dedup))
        for side in edge_index._found(index, members, "left_semi" if dedup else "inner"):
            above = above_scan(plan_of(side), "Bucketed: true")
            assert any("SortMergeJoin" in x for x in above)
            assert not any("Exchange" in x for x in above)
    edge_index.drop_index(spark, "lookup_test")
    again = edge_index.open_index(spark, str(tmp_path / "i"), "lookup_test", 8)
    assert tuples(edge_index.lookup_edges(again, members)) == tuples(incident_edges(edges, members))
    edge_index.drop_index(spark, "lookup_test")


# --- drawings

def test_the_fragments_are_one_valid_document(spark, hand_graph, tmp_path):
    nodes = hand_graph.vertices.limit(3).select("id", F.lit('<a & "b">\r\n\x01é😀').alias("label"),
                                                F.lit("marked").alias("class"))
    more, edges = nw.graph_export(hand_graph)
    nodes = nodes.unionByName(more.join(nodes.select("id"), "id", "left_anti")).repartition(4)
    path = str(tmp_path / "g")
    graphml.write_graphml(nodes, edges.repartition(3), path)
    files = graphml.ordered_files(spark, path)
    assert len(files) > 6
    text = "".join(open(f.removeprefix("file://"), encoding="utf-8").read() for f in files)
    space = "{http://graphml.graphdrawing.org/xmlns}"
    root = ET.fromstring(text)
    assert len(root.findall(f".//{space}node")) == nodes.count()
    assert len(root.findall(f".//{space}edge")) == edges.count() == 12
    known = {n.get("id") for n in root.iter(f"{space}node")}
    assert all(e.get("source") in known and e.get("target") in known
               for e in root.iter(f"{space}edge"))
    label = [n.find(f"{space}data").text for n in root.iter(f"{space}node")]
    assert label.count('<a & "b">\r\n�é😀') == 3
    back, edges_back = graphml.read_graphml(spark, path)
    assert tuples(back) == tuples(nodes.withColumn("label", F.replace(
        F.col("label"), F.lit("\x01"), F.lit("�"))))
    assert tuples(edges_back) == tuples(edges.select("src", "dst"))


# --- places and lists

def test_running_sums_of_a_hot_key(spark):
    rnd = random.Random(5)
    data = [(0 if rnd.random() < 0.5 else rnd.randrange(30), i, rnd.randrange(4))
            for i in range(4000)]
    df = spark.createDataFrame(data, "k long, id long, m long").repartition(6)
    got = running_before(df, ["k"], [F.desc("id")], "m")
    want, seen = [], defaultdict(int)
    for k, i, m in sorted(data, key=lambda r: -r[1]):
        want.append((k, i, m, seen[k]))
        seen[k] += m
    assert tuples(got) == sorted(want, key=repr)
    assert got.count() == 4000


def test_places_equal_row_numbers(spark, hand_graph):
    got = rk.fan_positions(hand_graph)
    ranked = [tuple(r) for r in rk.fan_ranking(hand_graph).collect()]
    assert [tuple(r) for r in got.orderBy("position").collect()] == [
        (*r, i) for i, r in enumerate(ranked, 1)]
    assert "SinglePartition" not in plan_of(got)
    empty = with_positions(spark.createDataFrame([], "id long"), [F.asc("id")])
    assert empty.collect() == []


def test_pages_are_read_by_place(spark, hand_graph, tmp_path):
    path = str(tmp_path / "p")
    rk.store_positions(rk.influence_positions(hand_graph), path)
    every = [tuple(r) for r in rk.page(spark, path, 1, 100).collect()]
    assert [r[-1] for r in every] == list(range(1, 12))
    assert [tuple(r) for r in rk.page(spark, path, 4, 3).collect()] == every[3:6]
    assert "GreaterThanOrEqual(position,4)" in plan_of(rk.page(spark, path, 4, 3))


def test_lists_of_a_giant_component(spark):
    giant = spark.range(0, 25_000).select(F.lit(0).cast("long").alias("component"), "id",
                                          F.concat(F.lit("n"), "id").alias("name"))
    small = spark.createDataFrame([(7_000_001, 7_000_001, "x"), (8, 30_000, "y"), (8, 30_001, "z")],
                                  "component long, id long, name string")
    chunks = member_chunks(giant.unionByName(small).repartition(7), "component", "name", size=300)
    lists = defaultdict(dict)
    for r in chunks.collect():
        assert 0 < len(r["members"]) <= 300
        lists[r["component"]][r["chunk_no"]] = r["members"]
    whole = {k: sum((v[i] for i in sorted(v)), []) for k, v in lists.items()}
    assert whole[0] == [f"n{i}" for i in range(25_000)] and whole[8] == ["y", "z"]
    assert whole[7_000_001] == ["x"] and len(lists[0]) == 84
    lines = cm.member_lines(chunks, "component").where("component = 0").orderBy("chunk_no").collect()
    assert "".join(r["line"] for r in lines) == "0->" + ",".join(whole[0])
