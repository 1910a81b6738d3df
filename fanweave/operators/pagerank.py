"""PageRank and personalized PageRank to a tolerance, as DataFrame supersteps.

Semantics (delta-based, like the graph library the original jobs called):
state per vertex is (rank, delta).  In each superstep every vertex whose
delta exceeds ``tol`` sends ``delta / outdegree`` along each out-edge
(parallel edges each send, self-loops send to themselves); a receiver adds
``(1 - reset) * sum`` to its rank and that increase becomes its delta;
non-receivers go quiet.  Iteration stops when no vertex sends.

* PageRank starts every vertex at (reset, reset) and finally scales ranks so
  they sum to the number of vertices.
* Personalized PageRank starts the source at (1, 1), the rest at 0, and
  finally divides by the sum so ranks sum to 1.  Many sources run in one
  job: state is keyed by (source, id) and only reached pairs are stored.

One superstep = ``state JOIN links`` + one ``GROUP BY dst``.  ``links`` is the
weighted edge table plus one "self" row per vertex, so a vertex's own
(rank, delta) travels to the same group as the messages it receives and the
state is read only once per superstep (see ``iterate``).  PageRank reads its
links in every superstep, so they are lists of receivers (``listed_links``), not
one row for each edge, four bytes each where ids allow it.  The shuffles of all
supersteps of a job lie on disk until it ends, so a job sends ``JOB_MESSAGES`` at
most, or runs one superstep; what its supersteps add to the ranks is summed up as
soon as it outgrows the ranks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import RESET_PROB, TOLERANCE, tie_key
from ..session import loop_partitions
from .graph import FollowGraph
from .iterate import decay_batch, fixed_partitioning, materialize, release

MESSAGES_PER_PARTITION = 2_000_000    # of one superstep over (source, vertex) pairs
MOST_GROUPS = 64                      # that a group of sources is cut into at once
LIST_SIZE = 1024                      # receivers that one row of PageRank's links holds, about
JOB_MESSAGES = 64_000_000             # of all supersteps of one PageRank job, unless it is only one
MOST_INCREMENTS = 4                   # rows of increments for each vertex before they are summed up


def _out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))


def hot_threshold(n_edges: int, n_parts: int, hot_degree: int | None = None) -> int:
    """Out-degree above which a vertex's edges would overload its partition:
    twice an average partition (at least 100k edges).  At most
    n_edges / threshold vertices can be hot, which bounds their broadcast."""
    if hot_degree is not None:
        return hot_degree
    return max(100_000, 2 * n_edges // max(1, n_parts))


def links(graph: FollowGraph, n_parts: int, hot: int | None) -> tuple[DataFrame, DataFrame | None, int]:
    """Split edge tables for the supersteps.

    * ``cold`` (src, dst, w, dst_deg, self): w = multiplicity / outdegree(src)
      for each distinct edge of a vertex with out-degree <= ``hot``, plus a
      self row (v, v, 0, deg(v), true) per vertex; checkpointed,
      hash-partitioned on ``src`` (co-partitioned with the state).
    * ``hot_edges`` (src, dst, w, dst_deg): the edges of vertices above
      ``hot``, partitioned on ``dst`` so one vertex's edges spread over every
      task; their senders reach them through a broadcast of the hot
      vertices' state.
    ``dst_deg`` (the receiver's out-degree) tells whether a receiver may send.
    Degrees are counted once, and the hot edges are only looked for where the counts show some;
    ``hot`` None keeps all edges together.
    Returns (cold, hot_edges or None, number of hot edges).
    """
    vdeg, counts = materialize(vertex_out_degrees(graph), {
        "hot": F.expr("sum(CASE WHEN deg > {} THEN 1 ELSE 0 END)".format(
            2 ** 62 if hot is None else hot))})
    deg = vdeg.where("deg > 0").select(F.col("id").alias("src"), "deg")
    pairs = graph.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    weighted = (pairs.join(deg, "src")
                .join(vdeg.select(F.col("id").alias("dst"), F.col("deg").alias("dst_deg")), "dst")
                .select("src", "dst", (F.col("m").cast("double") * (F.lit(1.0) / F.col("deg"))).alias("w"),
                        "dst_deg", "deg"))
    selfs = vdeg.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w"),
                        F.col("deg").alias("dst_deg"), F.lit(True).alias("self"))
    columns = ["src", "dst", "w", "dst_deg"]
    if not counts["hot"]:
        cold, _ = materialize(weighted.select(*columns, F.lit(False).alias("self"))
                              .unionByName(selfs).repartition(n_parts, "src"))
        return cold, None, 0
    weighted, _ = materialize(weighted)
    cold, _ = materialize(weighted.where(F.col("deg") <= hot)
                          .select(*columns, F.lit(False).alias("self"))
                          .unionByName(selfs).repartition(n_parts, "src"))
    hot_edges, m = materialize(weighted.where(F.col("deg") > hot).select(*columns)
                               .repartition(n_parts, "dst"), {"n": F.count(F.lit(1))})
    return cold, hot_edges, m["n"]


def listed_links(graph: FollowGraph, n_parts: int, hot: int
                 ) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None, int | None]:
    """PageRank's links.  Returns (degrees, lists, hot_edges, hot_ids, low), hot_edges and hot_ids None
    where no out-degree is above ``hot``:

    * ``degrees`` (id, deg) of every vertex, partitioned on ``id``;
    * ``lists`` (src, w, self, receivers): the receivers that get ``w`` = multiplicity / outdegree of
      a sender's delta, in lists of about ``LIST_SIZE`` dealt by a hash of the receiver, plus a self
      row (v, 0, true, [v]) per vertex; co-partitioned with the state. A receiver is held as its
      distance from ``low`` in four bytes, or, where ids are too far apart and ``low`` is None, as it is;
    * ``hot_edges`` (src, dst, w) of the vertices ``hot_ids`` above ``hot``, partitioned on ``dst``.
    """
    degrees, counts = materialize(vertex_out_degrees(graph).repartition(n_parts, "id"), {
        "hot": F.expr(f"sum(CASE WHEN deg > {hot} THEN 1 ELSE 0 END)"),
        "low": F.min("id"), "high": F.max("id")})
    low = counts["low"] or 0
    if (counts["high"] or 0) - low >= 2 ** 31:
        low = None

    def held(receiver: str):
        return F.col(receiver) if low is None else (F.col(receiver) - low).cast("int")

    edges, hot_edges, hot_ids = graph.edges.select("src", "dst"), None, None
    multiple = F.count(F.lit(1)).cast("double").alias("m")
    w = (F.col("m") * (F.lit(1.0) / F.col("deg"))).alias("w")
    if counts["hot"]:
        hot_ids, _ = materialize(degrees.where(F.col("deg") > hot).withColumnRenamed("id", "src"))
        hot_edges, _ = materialize(edges.join(F.broadcast(hot_ids), "src")
                                   .groupBy("src", "dst", "deg").agg(multiple)
                                   .select("src", "dst", w).repartition(n_parts, "dst"))
        edges = edges.join(F.broadcast(hot_ids), "src", "left_anti")
    # Dealt by sender once: the counts, the degrees and the lists need no other exchange.
    pairs = edges.repartition(n_parts, "src").groupBy("src", "dst").agg(multiple)
    lists = (pairs.join(degrees.withColumnRenamed("id", "src").hint("shuffle_hash"), "src")
             .groupBy("src", "m", "deg",
                      F.pmod(F.xxhash64("dst"), F.ceil(F.col("deg") / LIST_SIZE)).alias("list"))
             .agg(F.collect_list(held("dst")).alias("receivers"))
             .select("src", w, F.lit(False).alias("self"), "receivers"))
    selfs = degrees.select(F.col("id").alias("src"), F.lit(0.0).alias("w"), F.lit(True).alias("self"),
                           F.array(held("id")).alias("receivers"))
    # Both lie by the sender already.
    lists, _ = materialize(lists.unionByName(selfs))
    return degrees, lists, hot_edges, hot_ids, low


def degrees_of(cold: DataFrame) -> DataFrame:
    """(id, deg) of every vertex, from the self rows of the stored links."""
    return cold.where("self").select(F.col("src").alias("id"), F.col("dst_deg").alias("deg"))


def vertex_out_degrees(graph: FollowGraph) -> DataFrame:
    """(id, deg) for every vertex, 0 when it follows nobody."""
    deg = _out_degrees(graph.edges)
    return (graph.vertices.select("id")
            .join(deg, graph.vertices.id == deg.src, "left")
            .select("id", F.coalesce("deg", F.lit(0)).alias("deg")))


def _active(tol: float) -> str:
    return f"delta > {tol!r} AND deg > 0"


def _frontier_loop(start: DataFrame, ranks: DataFrame, step, cond: str, steps_per_job) -> list[DataFrame]:
    """Run supersteps job by job over a job-local state (id, delta, acc).

    A job starts from the vertices that may send (``cond``) with acc = 0;
    vertices touched during the job ride along (self rows) and collect
    their rank increments in ``acc``.  At the job's end the increments are set
    aside (checkpointed) and only the senders go on, so the long tail of a
    converging run touches a handful of rows, not the whole state.  Increments
    of more than ``MOST_INCREMENTS`` rows a vertex are added to ``ranks`` (id, rank)
    and deleted.  Returns the ranks and the increments (id, acc) not added yet, as
    the stored tables that they are columns of.
    """
    metrics = {"active": F.expr(f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END)"),
               "max_delta": F.expr(f"max(CASE WHEN {cond} THEN delta END)"),
               "rows": F.count(F.lit(1))}
    batch_of = steps_per_job if callable(steps_per_job) else (lambda m: steps_per_job)
    state, m = materialize(start, metrics)
    most = MOST_INCREMENTS * m["rows"]
    increments, rows = [], 0
    while m["active"]:
        before, batch = state, max(1, batch_of(m))
        nxt = state.where(cond).select("id", "delta", F.lit(0.0).alias("acc"))
        for _ in range(batch):
            nxt = step(nxt)
        state, m = materialize(nxt, metrics)
        if not increments:                          # what it held is in the ranks
            release(before)
        increments.append(state)
        rows += m["rows"]
        if rows > most:
            added, _ = materialize(_sum_ranks(ranks, [x.select("id", "acc") for x in increments], []))
            release(ranks, *increments[:-1])
            ranks, increments, rows = added, [], 0
    if not increments:
        release(state)
    return [ranks, *increments]


def _sum_ranks(base: DataFrame, increments: list[DataFrame], keys: list[str]) -> DataFrame:
    """rank = base rank + every increment (one aggregation at the end)."""
    parts = base.select(*keys, "id", F.col("rank").alias("acc"))
    for inc in increments:
        parts = parts.unionByName(inc)
    return parts.groupBy(*keys, "id").agg(F.sum("acc").alias("rank"))


def pagerank(graph: FollowGraph, tol: float = TOLERANCE, reset: float = RESET_PROB,
             steps_per_job=None, hot_degree: int | None = None) -> DataFrame:
    """(id, rank) for every vertex; ranks sum to the vertex count.

    ``steps_per_job``: supersteps per Spark job; default adapts to the
    observed largest delta (see ``iterate.decay_batch``).  ``hot_degree``:
    out-degree above which a vertex's edges leave the co-partitioned table
    (default ``hot_threshold``); with hot vertices every superstep is its own
    job, since the state is then read twice (join + broadcast)."""
    spark = graph.edges.sparkSession
    given = graph.n_edges is not None
    graph, n_edges = graph.materialize_counted()
    n = loop_partitions(spark, n_edges)
    d = 1.0 - reset
    hot = hot_threshold(n_edges, n, hot_degree)
    with fixed_partitioning(spark, n):
        vdeg, L, H, hot_ids, low = listed_links(graph, n, hot)
        start = vdeg.select("id", F.lit(reset).alias("delta"), F.lit(0.0).alias("acc"))
        cond = f"delta > {tol!r}"
        hot_part = "" if H is None else f"""
                        UNION ALL
                        SELECT /*+ BROADCAST(h) */ e.dst, NULL AS acc, h.delta * e.w AS msg
                        FROM {{hot}} e JOIN (SELECT /*+ BROADCAST(i) */ s.id, s.delta
                                             FROM {{state}} s JOIN {{hot_ids}} i ON s.id = i.src
                                             WHERE s.{cond}) h
                          ON e.src = h.id"""
        sql = f"""
            SELECT dst AS id,
                   CASE WHEN msg IS NULL THEN 0.0D ELSE {d!r}D * msg END AS delta,
                   coalesce(acc, 0.0D) + CASE WHEN msg IS NULL THEN 0.0D ELSE {d!r}D * msg END AS acc
            FROM (SELECT dst, max(acc) AS acc, sum(msg) AS msg
                  FROM (SELECT {"r" if low is None else f"r + {low}L"} AS dst, acc, msg
                        FROM (SELECT /*+ SHUFFLE_HASH(s) */ explode(l.receivers) AS r,
                                     CASE WHEN l.self THEN s.acc END AS acc,
                                     CASE WHEN NOT l.self THEN s.delta * l.w END AS msg
                              FROM {{links}} l JOIN {{state}} s
                                ON l.src = s.id AND (l.self OR s.{cond})){hot_part})
                  GROUP BY dst)"""
        tables = {"links": L} if H is None else {"links": L, "hot": H, "hot_ids": hot_ids}

        def step(state: DataFrame) -> DataFrame:
            return spark.sql(sql, state=state, **tables)

        # Whoever follows nobody has no list, so its delta is sent to nobody.
        most = max(1, min(16, JOB_MESSAGES // max(1, n_edges)))
        batch = 1 if H is not None else (steps_per_job or decay_batch(tol, d, most))
        base, *increments = _frontier_loop(start, vdeg.select("id", F.lit(reset).alias("rank")), step, cond,
                                           batch)
        ranks, m = materialize(_sum_ranks(base, [x.select("id", "acc") for x in increments], []),
                               {"total": F.sum("rank"), "n": F.count(F.lit(1))})
    release(base, *increments, vdeg, L, H, hot_ids)
    if not given:
        graph.release()
    if not m["n"]:
        return ranks
    factor = float(m["n"]) / float(m["total"])
    return ranks.select("id", (F.col("rank") * F.lit(factor)).alias("rank"))


def _push_sources(start: DataFrame, step, tol: float, live: int
                  ) -> Iterator[tuple[list[DataFrame], Callable[[DataFrame], DataFrame]]]:
    """Push the residuals of many sources with at most ``live`` messages in a superstep.

    The frontier (source, id, deg, delta) of a group of sources says how many messages its next
    superstep sends: the out-degrees of its active pairs. Where they exceed ``live``, the group is cut
    by a hash of the source and its parts go on one after the other, each from where it stands; a
    single source is never cut, as its messages are at most the edges. A superstep is a job of its
    own: what it gives a pair is stored once, as an increment, and only pairs that send are read on,
    so the volume is that of the messages, not that of all pairs in every superstep. Yields per
    finished group its increment tables and the filter that leaves its sources."""
    cond = _active(tol)
    metrics = {"active": F.expr(f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END)"),
               "max_delta": F.expr(f"max(CASE WHEN {cond} THEN delta END)"),
               "messages": F.expr(f"sum(CASE WHEN {cond} THEN deg ELSE 0 END)"),
               "low": F.expr(f"min(CASE WHEN {cond} THEN source END)"),
               "high": F.expr(f"max(CASE WHEN {cond} THEN source END)")}

    state, m = materialize(start, metrics)
    todo = [(state, m, [], [])]
    while todo:
        state, m, increments, cuts = todo.pop()
        while m["active"]:
            if m["messages"] > live and m["low"] != m["high"]:
                k = min(MOST_GROUPS, max(2, math.ceil(m["messages"] / live)))
                part = F.pmod(F.xxhash64(F.lit(len(cuts)), F.col("source")), F.lit(k))
                # At most MOST_GROUPS rows of counts.
                counts = {r["part"]: r.asDict() for r in state.groupBy(part.alias("part")).agg(
                    *[c.alias(name) for name, c in metrics.items()]).collect()}
                todo += [(state.where(part == j), counts.get(j, {"active": 0}),
                          [x.where(part == j) for x in increments], [*cuts, part == j])
                         for j in range(k)]
                break
            state, m = materialize(step(state.where(cond)), metrics)
            increments.append(state.select("source", "id", F.col("delta").alias("acc")))
        else:
            def own(df: DataFrame, cuts=tuple(cuts)) -> DataFrame:
                for cut in cuts:
                    df = df.where(cut)
                return df
            yield increments, own


def personalized_pagerank(graph: FollowGraph, sources: DataFrame | None = None,
                          tol: float = TOLERANCE, reset: float = RESET_PROB,
                          batches: int = 1, live_messages: int | None = None,
                          reduce: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(source, id, rank) for every source in ``sources`` (column ``id``;
    default: every vertex) and every vertex it reaches; per source ranks sum to 1.

    State is keyed by (source, id) and holds only reached pairs. On a giant component all sources
    together would reach quadratically many, so the sources fall apart into groups as soon as
    a superstep would send more than ``live_messages`` (default: 2 million per partition of the
    loop; see ``_push_sources``), and ``reduce`` is applied to the ranks of each finished group
    before they are stored. No pair is dropped: the result does not depend on the bound.
    ``batches`` > 1 begins with that many hash buckets of sources.
    """
    spark = graph.edges.sparkSession
    graph, n_edges = graph.materialize_counted()
    n = loop_partitions(spark, n_edges)
    live = live_messages or MESSAGES_PER_PARTITION * n
    d = 1.0 - reset
    results: list[DataFrame] = []
    with fixed_partitioning(spark, n):
        # Pair state for a hot vertex is not bounded (one row per source that
        # reaches it), so no broadcast split here: every edge stays co-partitioned.
        L, _, _ = links(graph, n, hot=None)
        vdeg = degrees_of(L)
        src_ids = (sources.select("id").distinct() if sources is not None
                   else graph.vertices.select("id"))
        seeds_all = src_ids.join(vdeg, "id").select(F.col("id").alias("source"), "id", "deg")
        # Messages are summed per (source, dst) before they are shuffled, so a celebrity costs
        # a task one row per source; the sort-merge join spills.
        edges = L.where("NOT self").select("src", "dst", "w", "dst_deg")
        sql = f"""
            SELECT s.source, l.dst AS id, max(l.dst_deg) AS deg, {d!r} * sum(s.delta * l.w) AS delta
            FROM {{links}} l JOIN {{state}} s ON l.src = s.id
            GROUP BY s.source, l.dst"""

        def step(state: DataFrame) -> DataFrame:
            return spark.sql(sql, links=edges, state=state)

        for b in range(batches):
            seeds = seeds_all if batches == 1 else seeds_all.where(
                F.pmod(F.xxhash64("source"), F.lit(batches)) == b)
            start = seeds.select("source", "id", "deg", F.lit(1.0).alias("delta")).repartition(n, "id")
            base = seeds.select("source", "id", F.lit(1.0).alias("rank"))
            for increments, own in _push_sources(start, step, tol, live):
                ranks = _sum_ranks(own(base), increments, ["source"])
                totals = ranks.groupBy("source").agg(F.sum("rank").alias("total"))
                part = ranks.join(totals, "source").select(
                    "source", "id", (F.col("rank") / F.col("total")).alias("rank"))
                results.append(materialize(reduce(part) if reduce else part)[0])
                if len(results) == MOST_GROUPS:
                    results = [materialize(_union(results))[0]]
    return _union(results)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def best_other(ppr: DataFrame) -> DataFrame:
    """A5+P2: per source the highest-ranked other vertex (id, recId).

    Ties on the 9-place rank go to the smallest id; a source that reaches no
    other vertex gets a null recId.  ``max_by`` is a mergeable aggregate, so a
    source with a huge reach is reduced map-side instead of sorted in one task.
    """
    other = (F.col("id") != F.col("source")) & (F.col("rank") > 0)
    key = F.when(other, F.struct(tie_key(F.col("rank")), -F.col("id")))
    return (ppr.groupBy("source").agg(F.max_by("id", key).alias("recId"))
            .select(F.col("source").alias("id"), "recId"))
