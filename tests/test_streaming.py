"""The streaming insert-if-absent sink: duplicates across micro-batches and reruns."""

import tempfile

from fanweave.sources.sinks import read_table
from fanweave.streaming.edge_sink import watch_edges


def test_stream_inserts_each_edge_once(spark):
    base = tempfile.mkdtemp(prefix="fanweave-stream-", dir="/tmp")
    src_dir = f"{base}/follow"
    schema = "Source long, Target long"
    spark.createDataFrame([(1, 2), (1, 2), (3, 4), (5, 1)], schema).write.parquet(f"{src_dir}/b1")
    members = spark.createDataFrame([(1,)], "id long")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{src_dir}/*")
        q = watch_edges(stream, members, f"{base}/sink", f"{base}/ckpt")
        q.awaitTermination(120)

    run()
    got = sorted(tuple(r) for r in read_table(spark, f"{base}/sink").collect())
    assert got == [(1, 2, "Directed"), (5, 1, "Directed")]
    # A second batch repeats an old edge and adds a new one.
    spark.createDataFrame([(1, 2), (1, 7)], schema).write.parquet(f"{src_dir}/b2")
    run()
    got = sorted(tuple(r) for r in read_table(spark, f"{base}/sink").collect())
    assert got == [(1, 2, "Directed"), (1, 7, "Directed"), (5, 1, "Directed")]
