"""Connected components (X3) and strongly connected components.

Both label a component with its smallest vertex id.

Connected components use the alternating large-star / small-star rounds
(Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014):
O(log^2 n) rounds independent of the diameter, so long chains do not need
one superstep per hop.  Every round is plain joins and aggregations on an
undirected edge set ``(a < b)``; a round ends with a checkpoint.

Convergence test (observed on the round's own aggregation, no extra pass):
the edge set is a forest of stars centred on each component's minimum iff no
vertex has both a smaller and a larger neighbour and no vertex has two
different smaller neighbours.

Strongly connected components first contract chains: a vertex with one in-edge
and one out-edge lies on the way between two others, and pointer doubling finds
both ends of its chain, or the smallest id of a cycle made of such vertices
only, in rounds that grow with the logarithm of the chain's length.  A chain is
then one edge; its vertices belong to a component exactly if both ends are in
the same one.  What is left goes through
trimming plus forward/backward colouring:
colour(v) = smallest id that reaches v; a vertex whose colour is its own id
is a root; the root's SCC is every vertex of that colour that reaches it
(a reverse breadth-first search restricted to the colour).  Finished vertices
leave the graph and the rounds repeat until none are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import loop_partitions
from .graph import FollowGraph
from .iterate import fixed_partitioning, materialize, run_supersteps


def _undirected(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b, one row per undirected edge."""
    return (edges.where(F.col("src") != F.col("dst"))
            .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
            .distinct())


def _star_round(E: DataFrame) -> tuple[DataFrame, dict]:
    """One large-star + small-star round on E(a, b), a < b.

    Neighbourhood minima are aggregates (combined map-side), never windows, and
    edge sets leave a round hash-partitioned on the whole edge, so the centre
    of a giant star is no hot partition.  The two joins on a vertex are plain
    shuffle joins of an edge table with one row per vertex, which adaptive
    execution splits where the centre makes them uneven.
    """
    both = E.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        E.select(F.col("b").alias("u"), F.col("a").alias("v")))
    stats = both.groupBy("u").agg(
        F.min("v").alias("mn"),
        F.expr("max(CASE WHEN v < u THEN v END)").alias("lo_max"),
        F.expr("min(CASE WHEN v > u THEN v END)").alias("hi_min"))
    violation = F.expr(
        "sum(CASE WHEN (lo_max IS NOT NULL AND hi_min IS NOT NULL) "
        "OR (lo_max IS NOT NULL AND lo_max <> mn) THEN 1 ELSE 0 END)")
    obs = Observation()
    stats = stats.observe(obs, violation.alias("violations")).select("u", "mn")
    # large-star: every edge (a, b) is re-hung on the smallest vertex of a's
    # closed neighbourhood.
    large = (E.join(stats, E.a == stats.u)
             .select(F.least("u", "mn").alias("a"), "b").distinct())
    # small-star: b links itself and its smaller neighbours to the smallest of them.
    least = large.groupBy("b").agg(F.min("a").alias("mb"))
    small = (large.join(least, "b")
             .select("mb", F.explode(F.array("a", "b")).alias("x"))
             .where(F.col("x") != F.col("mb"))
             .select(F.col("mb").alias("a"), F.col("x").alias("b")).distinct())
    out, _ = materialize(small)
    return out, dict(obs.get)


def connected_components(graph: FollowGraph) -> DataFrame:
    """(id, component) for every vertex (edges taken as undirected)."""
    graph, _ = graph.materialize_counted()
    E, m = materialize(_undirected(graph.edges), {"n": F.count(F.lit(1))})
    violations = m["n"]
    while violations:
        E, m = _star_round(E)
        violations = m["violations"]
    # Stars: b hangs on centre a; centres and isolated vertices label themselves.
    leaf = E.select(F.col("b").alias("leaf"), F.col("a").alias("centre"))
    out, _ = materialize(
        graph.vertices.select("id").join(leaf, F.col("id") == F.col("leaf"), "left")
        .select("id", F.coalesce("centre", "id").alias("component")))
    return out


# --------------------------------------------------------------------------- SCC


# alive(v) stays true while v has an alive in-neighbour and an alive
# out-neighbour (links carry each edge both ways, tagged, plus self rows).
# ``ins`` and ``outs`` count those neighbours, and only vertices that died in
# the last step say so: each takes one from the counts of its neighbours.
_TRIM_STEP = """
SELECT id, was AND ins > 0 AND outs > 0 AS alive, was AND NOT (ins > 0 AND outs > 0) AS died, ins, outs
FROM (
  SELECT /*+ SHUFFLE_HASH(s) */ l.dst AS id,
         max(CASE WHEN l.kind = 0 THEN s.alive END) AS was,
         sum(CASE WHEN l.kind = 0 THEN s.ins WHEN l.kind = 1 THEN -1 ELSE 0 END) AS ins,
         sum(CASE WHEN l.kind = 0 THEN s.outs WHEN l.kind = 2 THEN -1 ELSE 0 END) AS outs
  FROM {links} l JOIN {state} s ON l.src = s.id AND (l.kind = 0 OR s.died)
  GROUP BY l.dst)
"""


def _trim(E: DataFrame, steps_per_job: int) -> tuple[DataFrame, int]:
    """Edges between vertices that keep an in- and an out-edge after repeated
    peeling (a peeled vertex is its own SCC).  Peeling is a monotone vertex
    fixpoint, run as batched supersteps.  Returns the edges and their count."""
    spark = E.sparkSession
    ids = E.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    tagged = (E.select(F.col("src"), F.col("dst"), F.lit(1).alias("kind"))        # dst hears an in-neighbour
              .unionByName(E.select(F.col("dst").alias("src"), F.col("src").alias("dst"),
                                    F.lit(2).alias("kind")))                        # src hears an out-neighbour
              .unionByName(ids.select(F.col("id").alias("src"), F.col("id").alias("dst"),
                                      F.lit(0).alias("kind"))))
    links, _ = materialize(tagged.repartition("src"))
    # A vertex's own rows of the links are dealt by its id; kind 1 leaves it, kind 2 enters it.
    init = (links.groupBy(F.col("src").alias("id"))
            .agg(F.expr("sum(CASE WHEN kind = 2 THEN 1L ELSE 0L END)").alias("ins"),
                 F.expr("sum(CASE WHEN kind = 1 THEN 1L ELSE 0L END)").alias("outs"))
            .select("id", F.expr("ins > 0 AND outs > 0").alias("alive"),
                    F.expr("NOT (ins > 0 AND outs > 0)").alias("died"), "ins", "outs"))
    state, _, _ = run_supersteps(
        init, lambda st: spark.sql(_TRIM_STEP, links=links, state=st),
        {"died": F.expr("sum(CASE WHEN died THEN 1 ELSE 0 END)")},
        lambda m: not m["died"], steps_per_job)
    alive = state.where("alive").select("id")
    kept = (E.join(alive.select(F.col("id").alias("src")), "src", "left_semi")
            .join(alive.select(F.col("id").alias("dst")), "dst", "left_semi"))
    out, m = materialize(kept.repartition("src"), {"n": F.count(F.lit(1))})
    return out, m["n"]


# colour(v) = min over v and its in-neighbours' colours; idempotent at the fixpoint.
# A neighbour whose colour did not change in the last step has been heard before.
_COLOUR_STEP = """
SELECT id, c AS colour, c < own AS changed FROM (
  SELECT /*+ SHUFFLE_HASH(s) */ l.dst AS id, min(s.colour) AS c,
         min(CASE WHEN l.self THEN s.colour END) AS own
  FROM {links} l JOIN {state} s ON l.src = s.id AND (l.self OR s.changed)
  GROUP BY l.dst)
"""

# final(v) |= final of a same-colour out-neighbour (links are reversed), which
# says so in the step after it became final.
_CLOSE_STEP = """
SELECT id, fin AS final, fin AND NOT was AS new FROM (
  SELECT /*+ SHUFFLE_HASH(s) */ l.dst AS id, max(s.final) AS fin,
         max(CASE WHEN l.self THEN s.final END) AS was
  FROM {links} l JOIN {state} s ON l.src = s.id AND (l.self OR s.new)
  GROUP BY l.dst)
"""


def _chase(chain: DataFrame, inside: DataFrame, way: str, n: int) -> DataFrame:
    """(id, to, done, least): from each of the ``n`` chain vertices, the first vertex in direction
    ``way`` that is on no chain. Vertices that are not ``done`` lie on endless chains, and ``least``
    is the smallest id there. Only vertices whose pointer still lies inside take part in a round,
    and no two of them point to the same vertex, so a round has no hot key."""
    state = chain.join(inside, F.col(way) == F.col("c"), "left").select(
        "id", F.col(way).alias("to"), F.col("c").isNull().alias("done"),
        F.least("id", way).alias("least"))
    open_rows = {"open": F.expr("sum(CASE WHEN done THEN 0 ELSE 1 END)")}
    state, left = materialize(state, open_rows)
    reached = 1
    while left["open"] and reached < n:        # 2^k >= n hops have met a whole cycle
        ahead = state.select(F.col("id").alias("a"), F.col("to").alias("a_to"),
                             F.col("done").alias("a_done"), F.col("least").alias("a_least"))
        moved = state.where("NOT done").join(ahead, F.col("to") == F.col("a")).select(
            "id", F.col("a_to").alias("to"), F.col("a_done").alias("done"),
            F.least("least", "a_least").alias("least"))
        state, left = materialize(state.where("done").unionByName(moved), open_rows)
        reached *= 2
    return state


def _contract_chains(E: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(edges, chains, cycles) of simple edges without loops, None if there is no chain vertex.

    ``chains`` (id, first, last): the chain vertices with the two other vertices that their chain
    joins. ``cycles`` (id, component): those whose chain has no end. ``edges`` are the edges between
    other vertices plus one edge for each chain."""
    n_out = E.groupBy(F.col("src").alias("id")).agg(
        F.count(F.lit(1)).alias("o"), F.max("dst").alias("next"))
    n_in = E.groupBy(F.col("dst").alias("id")).agg(
        F.count(F.lit(1)).alias("i"), F.max("src").alias("prev"))
    chain, m = materialize(n_out.join(n_in, "id").where("o = 1 AND i = 1").select("id", "next", "prev"),
                           {"n": F.count(F.lit(1))})
    if not m["n"]:
        return None
    inside = chain.select(F.col("id").alias("c"))
    forth, back = (_chase(chain, inside, way, m["n"]) for way in ("next", "prev"))
    chains = (forth.where("done").select("id", F.col("to").alias("last"))
              .join(back.where("done").select("id", F.col("to").alias("first")), "id"))
    cycles = forth.where("NOT done").select("id", F.col("least").alias("component"))
    kept = (E.join(inside.withColumnRenamed("c", "src"), "src", "left_anti")
            .join(inside.withColumnRenamed("c", "dst"), "dst", "left_anti"))
    bridges = chains.select(F.col("first").alias("src"), F.col("last").alias("dst")).where("src <> dst")
    edges, _ = materialize(kept.select("src", "dst").unionByName(bridges).distinct())
    return edges, chains, cycles


def _chain_labels(found: DataFrame, chains: DataFrame) -> DataFrame:
    """Labels (id, component) of all vertices from those of the vertices that are on no chain: a
    chain between two vertices of one component, or from a vertex to itself, belongs to it. A
    component's label is the smallest id of all its vertices."""
    a = found.select(F.col("id").alias("first"), F.col("component").alias("ca"))
    b = found.select(F.col("id").alias("last"), F.col("component").alias("cb"))
    placed = chains.join(a, "first", "left").join(b, "last", "left").select(
        "id", F.when(F.col("ca") == F.col("cb"), F.col("ca")).alias("component"))
    lone = placed.where("component IS NULL").select("id", F.col("id").alias("component"))
    every = found.unionByName(placed.where("component IS NOT NULL"))
    least = every.groupBy("component").agg(F.min("id").alias("label"))
    return every.join(least, "component").select(
        "id", F.col("label").alias("component")).unionByName(lone)


def _with_self_rows(edges: DataFrame) -> DataFrame:
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    loops = ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(True).alias("self"))
    table, _ = materialize(edges.select("src", "dst", F.lit(False).alias("self"))
                           .unionByName(loops).repartition("src"))
    return table


def _scc_round(E: DataFrame, steps_per_job: int) -> DataFrame:
    """(id, component) for every vertex whose SCC is rooted at a colour root."""
    spark = E.sparkSession
    fwd = _with_self_rows(E)
    init = (fwd.where("self").select(F.col("src").alias("id"), F.col("src").alias("colour"),
                                     F.lit(True).alias("changed")).repartition("id"))
    colour, _, _ = run_supersteps(
        init, lambda st: spark.sql(_COLOUR_STEP, links=fwd, state=st),
        {"changed": F.expr("sum(CASE WHEN changed THEN 1 ELSE 0 END)")},
        lambda m: not m["changed"], steps_per_job)
    c1 = colour.select(F.col("id").alias("src"), F.col("colour").alias("cs"))
    c2 = colour.select(F.col("id").alias("dst"), F.col("colour").alias("cd"))
    same = (E.join(c1, "src").join(c2, "dst").where("cs = cd")
            .select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    back = _with_self_rows(same)
    roots = colour.select("id", (F.col("id") == F.col("colour")).alias("final"),
                          (F.col("id") == F.col("colour")).alias("new"))
    closed, _, _ = run_supersteps(
        roots, lambda st: spark.sql(_CLOSE_STEP, links=back, state=st),
        {"new": F.expr("sum(CASE WHEN new THEN 1 ELSE 0 END)")},
        lambda m: not m["new"], steps_per_job)
    fin, _ = materialize(closed.where("final").join(colour, "id")
                         .select("id", F.col("colour").alias("component")))
    return fin


def _scc_labels(E: DataFrame, n: int, steps_per_job: int) -> DataFrame | None:
    """(id, component) of the vertices of simple edges whose component is found to be more than the
    vertex itself or was a root; None if there is none."""
    count = {"n": F.count(F.lit(1))}
    done: list[DataFrame] = []
    while n:
        E, n = _trim(E, steps_per_job)
        if not n:
            break
        fin = _scc_round(E, steps_per_job)
        done.append(fin)
        gone = fin.select("id")
        E, m = materialize(E.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
                           .join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"), count)
        n = m["n"]
    assigned = None
    for part in done:
        assigned = part if assigned is None else assigned.unionByName(part)
    return assigned


def strongly_connected_components(graph: FollowGraph, steps_per_job: int = 8) -> DataFrame:
    """(id, component) for every vertex."""
    spark = graph.edges.sparkSession
    graph, n_edges = graph.materialize_counted()
    count = {"n": F.count(F.lit(1))}
    simple, m = materialize(graph.edges.where(F.col("src") != F.col("dst"))
                            .select("src", "dst").distinct(), count)
    contracted = _contract_chains(simple) if m["n"] else None
    E = simple if contracted is None else contracted[0]
    with fixed_partitioning(spark, loop_partitions(spark, 3 * n_edges)):
        E, m = materialize(E.repartition("src"), count)
        assigned = _scc_labels(E, m["n"], steps_per_job)
        v = graph.vertices.select("id")
        if assigned is not None:
            assigned, _ = materialize(assigned)
    if contracted is not None:
        _, chains, cycles = contracted
        ends = chains.select(F.explode(F.array("first", "last")).alias("id")).distinct()
        if assigned is None:
            others = ends.select("id", F.col("id").alias("component"))
        else:
            alone = ends.join(assigned.select("id"), "id", "left_anti")
            others = assigned.unionByName(alone.select("id", F.col("id").alias("component")))
        others, _ = materialize(others)
        assigned, _ = materialize(_chain_labels(others, chains).unionByName(cycles))
    if assigned is None:
        labelled = v.select("id", F.col("id").alias("component"))
    else:
        labelled = (v.join(assigned.withColumnRenamed("id", "aid"), F.col("id") == F.col("aid"), "left")
                    .select("id", F.coalesce("component", "id").alias("component")))
    out, _ = materialize(labelled)
    return out
