"""Insert-if-absent edge sinks fed by a stream of follow documents.

The original jobs looked every follow edge up in the store and inserted it
only when absent (the ``community`` and ``fansOf`` collections).  When the
follow documents arrive as a stream, the same sink is a ``foreachBatch``:
each micro-batch keeps the edges that touch the watched vertex set, drops
duplicates and anti-joins against what the sink already holds in the key
buckets that the batch touches.  The sink table itself is the state (no
unbounded in-memory state), and the query's checkpoint location makes
restarts resume without re-inserting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.neighborhood import incident_edges
from ..sources.readers import follows_from
from ..sources.sinks import insert_into_buckets


def watch_edges(follow_stream: DataFrame, members: DataFrame, sink_path: str,
                checkpoint_location: str, src_col: str = "Source", dst_col: str = "Target",
                available_now: bool = True) -> StreamingQuery:
    """Start a stream that appends, once each, the (Source, Target, Type)
    edges of the stream that touch a vertex in ``members`` (column ``id``,
    a static table, e.g. the sampled fans or the members of the selected
    communities)."""

    def write_batch(batch: DataFrame, _epoch: int) -> None:
        edges = follows_from(batch, src_col, dst_col)
        insert_into_buckets(incident_edges(edges, members, dedup=True), sink_path)

    writer = (follow_stream.writeStream.foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
