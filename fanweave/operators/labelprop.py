"""Label propagation (X5): synchronous community detection for a fixed step count.

Every vertex starts with its own id as label.  In each step every edge passes
each endpoint's label to the other endpoint (parallel edges pass repeatedly,
a self-loop passes a vertex's label to itself twice); each vertex with
messages takes the most frequent label, ties to the smallest label; vertices
without edges keep their own id.  The step count is honoured exactly (an
isolated 2-cycle swaps labels every step); whether labels have settled is
never estimated.

A step in full: state JOIN senders (co-partitioned on the sender id) ->
messages dealt by receiver, the only shuffle -> GROUP BY (receiver, label) count
-> GROUP BY receiver max_by, both where the rows lie.  The neighbours of a vertex
are spread over all tasks, so counts before the shuffle would hardly be fewer
rows than messages, and counts dealt by (receiver, label) would be shuffled once
more.  Only a celebrity is counted so, in every map task first: it is never whole
in one task.  The table of senders is read in every step, so it holds lists of
receivers, not one row for each edge, four bytes each where ids allow it; a
message's receiver and label share one long.

A receiver's counts only move when a neighbour's label has.  Once the changed
senders make up at most 1 / ``FEW`` of all messages, and the counts are at most
1 / ``LESS`` as many as those, the counts are kept, and a step sends the changes
only: each changed sender takes its old label from its receivers' counts and adds
its new one.  (More counts would take more disk than the messages do.)  A step
that no sender enters with a changed label gives every vertex the label it has,
and so do all after it.

What a step stored goes when the next one is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import LPA_STEPS
from ..session import loop_partitions
from .graph import FollowGraph
from .iterate import fixed_partitioning, materialize, release
from .pagerank import hot_threshold

LIST_SIZE = 1024    # receivers that one row of the stored senders holds, about
FEW = 4             # changed senders with at most 1 / FEW of the messages are few
LESS = 2            # counts that are kept are at most 1 / LESS as many as the messages


def receiver_lists(pairs: DataFrame, low: int, narrow: bool) -> DataFrame:
    """(sender, m, far, receivers) from (sender, receiver, m, far, k): the receivers that hear a sender
    ``m`` times, in lists of about ``LIST_SIZE`` dealt by a hash of the receiver; ``k`` is at least the
    sender's number of receivers. ``narrow`` lists hold a receiver as its distance from ``low``."""
    lists = F.ceil(F.col("k") / LIST_SIZE)
    receiver = (F.col("receiver") - low).cast("int") if narrow else F.col("receiver")
    return (pairs.groupBy("sender", "m", "far", F.pmod(F.xxhash64("receiver"), lists).alias("list"))
            .agg(F.collect_list(receiver).alias("receivers"))
            .select("sender", "m", "far", "receivers"))


def dealt_by_receiver(messages: DataFrame, n: int, low: int, high: int) -> DataFrame:
    """(receiver, label, m), of ids from ``low`` to ``high``, partitioned by the receiver; receiver and
    label cross the shuffle as one long where they fit."""
    span = high - low + 1
    if span * span >= 2 ** 63:
        return messages.repartition(n, "receiver")
    low = f"{low}L"
    return (messages.selectExpr(f"(receiver - {low}) * {span}L + (label - {low}) AS both", "m")
            .repartition(n, F.expr(f"both div {span}L + {low}"))
            .selectExpr(f"both div {span}L + {low} AS receiver",
                        f"both % {span}L + {low} AS label", "m"))


def best_label(most: int, low: int, high: int) -> str:
    """SQL of the label with the largest ``c``, ties to the smallest, for counts up to ``most`` and
    labels from ``low`` to ``high``. Count and label share one long where they fit, as a maximum of
    longs is hashed and one of structs sorts all its rows."""
    span = high - low + 1
    if (most + 1) * span < 2 ** 63:
        return f"{high} - max(c * {span} + ({high} - label)) % {span}"
    return "max_by(label, struct(c, -label))"


def label_propagation(graph: FollowGraph, steps: int = LPA_STEPS,
                      hot_degree: int | None = None) -> DataFrame:
    """(id, label) for every vertex after ``steps`` synchronous steps.

    Labels travel both ways, so a celebrity is a hot *sender* and a hot
    *receiver*: the messages of a vertex of a degree above ``hot_degree``
    (default ``hot_threshold``) leave the co-partitioned table, are spread by
    receiver and meet their sender's label through a broadcast (at most
    edges / threshold such vertices); messages to it are counted before they are
    shuffled.  Each step is its own job.
    """
    spark = graph.edges.sparkSession
    given = graph.n_edges is not None
    graph, n_edges = graph.materialize_counted()
    n = loop_partitions(spark, 2 * n_edges)
    hot = hot_threshold(2 * n_edges, n, hot_degree)
    with fixed_partitioning(spark, n):
        # (sender, receiver): an edge passes each end's label to the other end.
        heard_by = graph.edges.selectExpr(
            "inline(array(struct(src AS sender, dst AS receiver), struct(dst AS sender, src AS receiver)))")
        degrees, seen = materialize(heard_by.groupBy("sender").agg(F.count(F.lit(1)).alias("k")),
                                    {"hot": F.expr(f"sum(CASE WHEN k > {hot} THEN 1 ELSE 0 END)"),
                                     "low": F.min("sender"), "high": F.max("sender")})
        n_hot, low, high = seen["hot"] or 0, seen["low"] or 0, seen["high"] or 0
        narrow = high - low < 2 ** 31
        celebrities, near = None, heard_by
        if n_hot:
            celebrities, _ = materialize(degrees.where(f"k > {hot}"))
            near = near.join(F.broadcast(celebrities.select("sender")), "sender", "left_anti")

        def listed(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
            """The lists of (sender, receiver) rows; ``m`` counts how often receiver hears sender."""
            pairs = (pairs.groupBy("sender", "receiver").agg(F.count(F.lit(1)).alias("m"))
                     .join(sizes, "sender").withColumn("far", F.lit(False)))
            if n_hot:
                far = celebrities.select(F.col("sender").alias("receiver"), F.lit(True).alias("yes"))
                pairs = pairs.join(F.broadcast(far), "receiver", "left").withColumn(
                    "far", F.coalesce("yes", F.lit(False)))
            return receiver_lists(pairs, low, narrow)

        S, _ = materialize(listed(near.repartition(n, "sender"), degrees.hint("shuffle_hash")))
        tables, fans = {"senders": S}, S
        if n_hot:
            # Counted by (sender, receiver), so no task makes all lists of a hot sender.
            tables["hot"], _ = materialize(listed(
                heard_by.join(F.broadcast(celebrities.select("sender")), "sender", "left_semi"),
                F.broadcast(celebrities)))
            tables["hot_ids"] = celebrities.select("sender")
            fans = S.unionByName(tables["hot"])
        release(degrees)
        if not given:
            release(graph.edges_path)

        def heard(state: DataFrame, said: str, then: str, far: bool) -> DataFrame:
            """(receiver, label, m): ``then`` over ``said`` by the senders in ``state`` to every receiver."""
            where = "" if not n_hot else f" WHERE {'' if far else 'NOT '}x.far"
            hot_part = "" if not n_hot else f"""
                UNION ALL
                SELECT /*+ BROADCAST(s) */ explode(x.receivers) AS r, {said}, x.m
                FROM {{hot}} x JOIN (SELECT /*+ BROADCAST(i) */ v.* FROM {{state}} v
                                     JOIN {{hot_ids}} i ON v.id = i.sender) s ON x.sender = s.id{where}"""
            return spark.sql(f"""
                {then} FROM (
                  SELECT {f"r + {low}L" if narrow else "r"} AS receiver, * EXCEPT (r) FROM (
                    SELECT /*+ SHUFFLE_HASH(s) */ explode(x.receivers) AS r, {said}, x.m
                    FROM {{senders}} x JOIN {{state}} s ON x.sender = s.id{where}{hot_part}))""",
                state=state, **tables)

        def counted(messages: DataFrame) -> DataFrame:
            return messages.groupBy("receiver", "label").agg(F.sum("m").alias("c"))

        def recount(state: DataFrame, far: bool) -> DataFrame:
            messages = heard(state, "s.label", "SELECT *", far)
            return counted(messages if far else dealt_by_receiver(messages, n, low, high))

        def recounted(counts: DataFrame, state: DataFrame, far: bool) -> DataFrame:
            moved = heard(state.where("label <> old"), "s.label, s.old",
                          "SELECT receiver, inline(array(struct(label, m), struct(old AS label, -m AS m)))",
                          far)
            moved = moved if far else dealt_by_receiver(moved, n, low, high)
            # Both lie by receiver, so kept counts stay where they are.
            return counted(counts.withColumnRenamed("c", "m").unionByName(moved)).where("c <> 0")

        best = F.expr(best_label(2 * n_edges, low, high)).alias("new")
        moved = {"messages": F.expr("sum(CASE WHEN label <> old THEN k ELSE 0 END)"), "counts": F.sum("labels")}
        state, m = materialize(fans.groupBy("sender").agg(F.sum(F.size("receivers")).alias("k")).select(
            F.col("sender").alias("id"), F.col("sender").alias("label"), "k"), {"messages": F.sum("k")})
        total = moving = m["messages"] or 0
        sides, kept, few = [False, True] if n_hot else [False], [], False
        for _ in range(steps):
            if not moving:
                break
            before = [state, *kept]
            if few:
                kept = [materialize(recounted(kept[i], state, far) if kept else recount(state, far))[0]
                        for i, far in enumerate(sides)]
                tallies = kept
            else:
                kept, tallies = [], [recount(state, far) for far in sides]
            chosen = [t.groupBy("receiver").agg(best, F.count(F.lit(1)).alias("labels")) for t in tallies]
            state, m = materialize(
                state.select("id", F.col("label").alias("old"), "k").join(
                    chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1]),
                    F.col("id") == F.col("receiver")).select(
                        "id", F.col("new").alias("label"), "old", "k", "labels"), moved)
            release(*before)
            moving = m["messages"]
            few = moving * FEW <= total and m["counts"] * LESS <= total
        out, _ = materialize(
            graph.vertices.select("id").join(state.select(F.col("id").alias("lid"), "label"),
                                             F.col("id") == F.col("lid"), "left")
            .select("id", F.coalesce("label", "id").alias("label")))
    release(state, *kept, *tables.values(), celebrities)
    if not given:
        graph.release()
    return out
