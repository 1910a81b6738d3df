"""DuckDB oracle SQL for every registered query (tables pre-registered as views).

The oracles are written independently of the Spark plans: connected
components by plain min-label propagation to a fixpoint, strongly connected
components by a reachability closure, the fan sample by a window, the
iterative ranks by recursive CTEs that carry the whole state per iteration.
"""

from __future__ import annotations

from ..functions.expr import LPA_STEPS, RESET_PROB, TOLERANCE
from ..sources.tpch_graphs import follow_sql, users_sql

D = 1.0 - RESET_PROB


def _graph(kind: str) -> str:
    """CTEs users, follow, vertices for graph ``kind`` (no WITH keyword)."""
    return f"""
users AS ({users_sql(kind)}),
follow AS ({follow_sql(kind)}),
user_attr AS (
  SELECT id, first(name ORDER BY name, intro) AS name, first(intro ORDER BY name, intro) AS intro
  FROM users GROUP BY id),
vertices AS (
  SELECT i.id,
         CASE WHEN u.id IS NULL THEN 'Unknown' ELSE u.name END AS name,
         CASE WHEN u.id IS NULL THEN 'Unknown' ELSE u.intro END AS intro
  FROM (SELECT id FROM users UNION SELECT src FROM follow UNION SELECT dst FROM follow) i
  LEFT JOIN user_attr u ON u.id = i.id)"""


def _with(kind: str, *ctes: str, recursive: bool = False) -> str:
    parts = [_graph(kind)] + [c for c in ctes if c]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)


CREATOR = "creator AS (SELECT dst AS id FROM follow GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"
TOP3 = "creator AS (SELECT dst AS id FROM follow GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 3)"
TOP20 = "creator AS (SELECT dst AS id FROM follow GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 20)"
MOST_ACTIVE20 = ("who AS (SELECT src AS id FROM follow GROUP BY src "
                 "ORDER BY count(*) DESC, src LIMIT 20)")
MOST_ACTIVE = ("who AS (SELECT src AS id FROM follow GROUP BY src "
               "ORDER BY count(*) DESC, src LIMIT 1)")

# --------------------------------------------------------------- PageRank

PR_CTES = f"""
deg AS (SELECT src, count(*) AS deg FROM follow GROUP BY src),
w AS (SELECT f.src, f.dst, CAST(count(*) AS DOUBLE) * (1.0::DOUBLE / d.deg) AS w
      FROM follow f JOIN deg d ON d.src = f.src GROUP BY f.src, f.dst, d.deg),
pr(it, id, deg, rank, delta, active) AS (
  SELECT 0, v.id, coalesce(d.deg, 0), {RESET_PROB!r}::DOUBLE, {RESET_PROB!r}::DOUBLE,
         count(*) FILTER (WHERE coalesce(d.deg, 0) > 0) OVER ()
  FROM vertices v LEFT JOIN deg d ON d.src = v.id
  UNION ALL
  SELECT it, id, deg, rank, delta,
         count(*) FILTER (WHERE delta > {TOLERANCE!r} AND deg > 0) OVER ()
  FROM (
    SELECT s.it + 1 AS it, s.id, s.deg,
           CASE WHEN m.msg IS NULL THEN s.rank ELSE s.rank + {D!r} * m.msg END AS rank,
           CASE WHEN m.msg IS NULL THEN 0.0::DOUBLE ELSE {D!r} * m.msg END AS delta
    FROM pr s
    LEFT JOIN (SELECT w.dst, sum(p.delta * w.w) AS msg
               FROM pr p JOIN w ON w.src = p.id
               WHERE p.delta > {TOLERANCE!r} AND p.deg > 0 AND p.active > 0
               GROUP BY w.dst) m ON m.dst = s.id
    WHERE s.active > 0)
),
last AS (SELECT * FROM pr WHERE it = (SELECT max(it) FROM pr)),
ranks AS (SELECT id, rank * ((SELECT count(*) FROM last) / (SELECT sum(rank) FROM last)) AS rank
          FROM last)"""


def _ppr_ctes(seeds: str) -> str:
    """All-sources personalized PageRank; ``seeds`` selects the source ids (column id)."""
    return f"""
deg AS (SELECT src, count(*) AS deg FROM follow GROUP BY src),
w AS (SELECT f.src, f.dst, CAST(count(*) AS DOUBLE) * (1.0::DOUBLE / d.deg) AS w
      FROM follow f JOIN deg d ON d.src = f.src GROUP BY f.src, f.dst, d.deg),
seeds AS ({seeds}),
ppr(it, source, id, deg, rank, delta, active) AS (
  SELECT 0, v.id, v.id, coalesce(d.deg, 0), 1.0::DOUBLE, 1.0::DOUBLE,
         count(*) FILTER (WHERE coalesce(d.deg, 0) > 0) OVER ()
  FROM seeds v LEFT JOIN deg d ON d.src = v.id
  UNION ALL
  SELECT it, source, id, deg, rank, delta,
         count(*) FILTER (WHERE delta > {TOLERANCE!r} AND deg > 0) OVER ()
  FROM (
    SELECT x.it, x.source, x.id, coalesce(x.deg, dd.deg, 0) AS deg,
           CASE WHEN x.msg IS NULL THEN x.old ELSE x.old + {D!r} * x.msg END AS rank,
           CASE WHEN x.msg IS NULL THEN 0.0::DOUBLE ELSE {D!r} * x.msg END AS delta
    FROM (
      SELECT coalesce(s.it, m.it) + 1 AS it, coalesce(s.source, m.source) AS source,
             coalesce(s.id, m.dst) AS id, s.deg, coalesce(s.rank, 0.0::DOUBLE) AS old, m.msg
      FROM (SELECT * FROM ppr WHERE active > 0) s
      FULL OUTER JOIN (
        SELECT p.it, p.source, w.dst, sum(p.delta * w.w) AS msg
        FROM ppr p JOIN w ON w.src = p.id
        WHERE p.active > 0 AND p.delta > {TOLERANCE!r} AND p.deg > 0
        GROUP BY p.it, p.source, w.dst) m
      ON s.source = m.source AND s.id = m.dst) x
    LEFT JOIN deg dd ON dd.src = x.id)
),
last AS (SELECT * FROM ppr WHERE it = (SELECT max(it) FROM ppr)),
pranks AS (SELECT source, id, rank / sum(rank) OVER (PARTITION BY source) AS rank FROM last),
recs AS (
  SELECT s.id, x.recId FROM seeds s LEFT JOIN (
    SELECT source, id AS recId,
           row_number() OVER (PARTITION BY source ORDER BY round(rank, 9) DESC, id) AS rn
    FROM pranks WHERE id <> source AND rank > 0) x ON x.source = s.id AND x.rn = 1)"""


# --------------------------------------------------------------- components

CC_CTES = """
und AS (SELECT src AS a, dst AS b FROM follow WHERE src <> dst
        UNION SELECT dst, src FROM follow WHERE src <> dst),
cc(it, id, comp, changed) AS (
  SELECT 0, id, id, count(*) OVER () FROM vertices
  UNION ALL
  SELECT it, id, comp, count(*) FILTER (WHERE moved) OVER () FROM (
    SELECT c.it + 1 AS it, c.id, least(c.comp, coalesce(m.mc, c.comp)) AS comp,
           coalesce(m.mc < c.comp, false) AS moved
    FROM cc c
    LEFT JOIN (SELECT u.b AS id, min(p.comp) AS mc FROM cc p JOIN und u ON u.a = p.id
               WHERE p.changed > 0 GROUP BY u.b) m ON m.id = c.id
    WHERE c.changed > 0)
),
labels AS (SELECT id, comp AS component FROM cc WHERE it = (SELECT max(it) FROM cc)),
sizes AS (SELECT component, count(*) AS size FROM labels GROUP BY component)"""


def _band_members(lo: int, hi: int, name: str) -> str:
    return (f"{name} AS (SELECT l.id FROM labels l JOIN sizes s ON s.component = l.component "
            f"WHERE s.size >= {lo} AND s.size < {hi})")


def _band_edges(members: str, name: str) -> str:
    return (f"{name} AS (SELECT DISTINCT src AS Source, dst AS Target, 'Directed' AS Type FROM follow "
            f"WHERE src IN (SELECT id FROM {members}) OR dst IN (SELECT id FROM {members}))")


# The component of one vertex (most followed) from its forward and backward reach, the others from
# the closure of the graph without it.
SCC_CTES = """
e AS (SELECT DISTINCT src, dst FROM follow WHERE src <> dst),
hub AS (SELECT dst AS id FROM follow GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
forth(id) AS (SELECT id FROM hub UNION SELECT e.dst FROM forth f JOIN e ON e.src = f.id),
back(id) AS (SELECT id FROM hub UNION SELECT e.src FROM back f JOIN e ON e.dst = f.id),
giant AS (SELECT id FROM forth INTERSECT SELECT id FROM back),
rest AS (SELECT id FROM vertices EXCEPT SELECT id FROM giant),
e2 AS (SELECT src, dst FROM e SEMI JOIN rest a ON a.id = src SEMI JOIN rest b ON b.id = dst),
reach(a, b) AS (SELECT id, id FROM rest UNION SELECT r.a, e2.dst FROM reach r JOIN e2 ON e2.src = r.b)"""

LPA_CTES = f"""
heard AS (SELECT dst AS r, src AS s FROM follow UNION ALL SELECT src AS r, dst AS s FROM follow),
lpa(it, id, label) AS (
  SELECT 0, id, id FROM (SELECT DISTINCT s AS id FROM heard)
  UNION ALL
  SELECT it, r, label FROM (
    SELECT p.it + 1 AS it, h.r, p.label,
           row_number() OVER (PARTITION BY h.r ORDER BY count(*) DESC, p.label) AS rn
    FROM lpa p JOIN heard h ON h.s = p.id
    WHERE p.it < {LPA_STEPS}
    GROUP BY p.it, h.r, p.label)
  WHERE rn = 1
),
labels AS (
  SELECT v.id, coalesce(l.label, v.id) AS label FROM vertices v
  LEFT JOIN (SELECT id, label FROM lpa WHERE it = {LPA_STEPS}) l ON l.id = v.id),
lsizes AS (SELECT label, count(*) AS size FROM labels GROUP BY label)"""

FAN_SAMPLE = """
fe AS (SELECT f.dst AS creator, f.src AS fan,
              row_number() OVER (PARTITION BY f.dst ORDER BY f.src) AS rn,
              count(*) OVER (PARTITION BY f.dst) AS n
       FROM follow f WHERE f.dst IN (SELECT id FROM creator)),
sample AS (SELECT creator, fan FROM fe WHERE rn <= floor(0.1 * n))"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["users_scan"] = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS intro FROM customer"
    q["follow_scan"] = _with("full") + " SELECT src, dst, 1.0::DOUBLE AS weight FROM follow"
    q["follow_scan_alt_layout"] = q["follow_scan"]
    q["graph_vertices"] = _with("full") + " SELECT id, name, intro FROM vertices"
    q["fan_edge_subgraph"] = (_with("full", CREATOR) +
                              " SELECT src, dst, 1.0::DOUBLE AS weight FROM follow "
                              "WHERE dst IN (SELECT id FROM creator)")
    q["fan_subgraph_vertices"] = (_with("full", CREATOR) +
                                  " SELECT id, 'Unknown' AS name, 'Unknown' AS intro FROM ("
                                  "SELECT src AS id FROM follow WHERE dst IN (SELECT id FROM creator) "
                                  "UNION SELECT dst FROM follow WHERE dst IN (SELECT id FROM creator))")
    q["graph_nodes_export"] = (_with("orders") +
                               " SELECT id, CAST(id AS VARCHAR) AS label, 'marked' AS class FROM vertices")
    q["graph_edges_export"] = (_with("orders") +
                               " SELECT CAST(src AS VARCHAR) || '-' || CAST(dst AS VARCHAR) AS edge_id, "
                               "src, dst, true AS directed FROM follow")
    q["fan_counts"] = _with("full") + " SELECT dst AS id, count(*) AS fans FROM follow GROUP BY dst"
    q["max_in_degree"] = (_with("full") + " SELECT dst AS id, count(*) AS degree FROM follow "
                          "GROUP BY dst ORDER BY degree DESC, id LIMIT 1")
    q["max_out_degree"] = (_with("full") + " SELECT src AS id, count(*) AS degree FROM follow "
                           "GROUP BY src ORDER BY degree DESC, id LIMIT 1")
    fan_rank = (_with("full") + " SELECT v.id, v.name, v.intro, f.fans FROM vertices v "
                "JOIN (SELECT dst, count(*) AS fans FROM follow GROUP BY dst) f ON f.dst = v.id "
                "ORDER BY f.fans DESC, v.id")
    q["fan_ranking"] = fan_rank
    q["top_fans"] = fan_rank + " LIMIT 10"
    q["pagerank"] = _with("full", PR_CTES, recursive=True) + " SELECT id, round(rank, 6) AS rank FROM ranks"
    infl = (_with("full", PR_CTES, recursive=True) +
            " SELECT v.id, v.name, v.intro, round(r.rank, 6) AS rank FROM vertices v "
            "JOIN ranks r ON r.id = v.id ORDER BY round(r.rank, 9) DESC, v.id")
    q["influence_ranking"] = infl
    q["top_influence"] = infl + " LIMIT 10"
    q["personalized_pagerank_one"] = (
        _with("full", MOST_ACTIVE, _ppr_ctes("SELECT id FROM who"), recursive=True) +
        " SELECT id, round(rank, 6) AS rank FROM pranks")
    q["recommend_one"] = (_with("full", MOST_ACTIVE20, _ppr_ctes("SELECT id FROM who"), recursive=True) +
                          " SELECT id, recId FROM recs")
    q["personal_recommendations"] = (
        _with("orders", _ppr_ctes("SELECT id FROM vertices"), recursive=True) +
        " SELECT id, recId FROM recs")
    q["connected_components"] = _with("full", CC_CTES, recursive=True) + " SELECT id, component FROM labels"
    q["connected_components_sparse"] = (_with("orders", CC_CTES, recursive=True) +
                                        " SELECT id, component FROM labels")
    q["community_members"] = (_with("orders", CC_CTES, recursive=True) +
                              " SELECT l.component, v.id, v.name FROM labels l JOIN vertices v ON v.id = l.id")
    q["community_sizes"] = _with("orders", CC_CTES, recursive=True) + " SELECT component, size FROM sizes"
    q["community_census"] = (
        _with("orders", CC_CTES, recursive=True) +
        """, bands(band, o) AS (VALUES ('1', 1), ('2-4', 2), ('5-9', 3), ('10+', 4)),
        banded AS (SELECT CASE WHEN size = 1 THEN '1' WHEN size < 5 THEN '2-4'
                               WHEN size < 10 THEN '5-9' ELSE '10+' END AS band FROM sizes)
        SELECT b.band, count(x.band) AS communities FROM bands b
        LEFT JOIN banded x ON x.band = b.band GROUP BY b.band""")
    q["isolated_users"] = (
        _with("orders", CC_CTES, recursive=True) +
        " SELECT l.component, CAST(l.component AS VARCHAR) || '->' || v.name AS line "
        "FROM labels l JOIN sizes s ON s.component = l.component JOIN vertices v ON v.id = l.id "
        "WHERE s.size = 1")
    q["community_edges"] = (
        _with("orders", CC_CTES, _band_members(10, 20, "members"), _band_edges("members", "cedges"),
              recursive=True) + " SELECT Source, Target, Type FROM cedges")
    q["community_edges_incremental"] = (
        _with("orders", CC_CTES, _band_members(10, 20, "members"), _band_edges("members", "cedges"),
              _band_members(10, 15, "old_members"), _band_edges("old_members", "stored"),
              recursive=True) +
        " SELECT Source, Target, Type FROM cedges EXCEPT SELECT Source, Target, Type FROM stored")
    q["fan_sample"] = _with("full", TOP20, FAN_SAMPLE) + " SELECT creator, fan FROM sample"
    q["fan_sample_all_creators"] = (
        _with("full", "creator AS (SELECT DISTINCT dst AS id FROM follow)", FAN_SAMPLE) +
        " SELECT creator, fan FROM sample")
    q["fan_ego_edges"] = (
        _with("full", CREATOR, FAN_SAMPLE) +
        " SELECT DISTINCT src AS Source, dst AS Target, 'Directed' AS Type FROM follow "
        "WHERE src IN (SELECT fan FROM sample) OR dst IN (SELECT fan FROM sample)")
    q["creator_fan_star"] = (
        _with("full", TOP3, PR_CTES, recursive=True) +
        " SELECT f.src AS Source, f.dst AS Target, round(r.rank, 6) AS Weight, 'Directed' AS Type "
        "FROM follow f JOIN ranks r ON r.id = f.dst WHERE f.dst IN (SELECT id FROM creator)")
    q["id_list_roundtrip"] = (_with("orders", CC_CTES, _band_members(10, 20, "members"), recursive=True) +
                              " SELECT id FROM members")
    q["id_list_edges"] = (
        _with("orders", CC_CTES, _band_members(10, 20, "members"), recursive=True) +
        " SELECT f.src AS Source, f.dst AS Target, 'Directed' AS Type FROM follow f "
        "JOIN members m ON m.id = f.src "
        "UNION ALL SELECT f.src, f.dst, 'Directed' FROM follow f JOIN members m ON m.id = f.dst")
    q["strongly_connected_components"] = (
        _with("full", SCC_CTES, recursive=True) +
        " SELECT r1.b AS id, min(r1.a) AS component FROM reach r1 "
        "JOIN reach r2 ON r2.a = r1.b AND r2.b = r1.a GROUP BY r1.b "
        "UNION ALL SELECT id, (SELECT min(id) FROM giant) FROM giant")
    q["label_propagation"] = _with("full", LPA_CTES, recursive=True) + " SELECT id, label FROM labels"
    q["lpa_communities"] = (_with("full", LPA_CTES, recursive=True) +
                            " SELECT label, size FROM lsizes WHERE size > 10")
    q["lpa_community_members"] = (
        _with("full", LPA_CTES, recursive=True) +
        " SELECT l.label, l.id FROM labels l JOIN lsizes s ON s.label = l.label WHERE s.size > 10")
    q["job_top_k_fans"] = q["top_fans"]
    q["job_top_k_up"] = q["top_influence"]
    q["job_personal_rec"] = q["personal_recommendations"]
    top10 = """top10 AS (SELECT id, rank FROM ranks ORDER BY round(rank, 9) DESC, id LIMIT 10)"""
    q["job_top_up_fans"] = (
        _with("full", PR_CTES, top10, recursive=True) +
        " SELECT f.src AS Source, f.dst AS Target, round(t.rank, 6) AS Weight, 'Directed' AS Type "
        "FROM follow f JOIN top10 t ON t.id = f.dst")
    q["job_fans_of"] = (
        _with("full", TOP3, FAN_SAMPLE) +
        " SELECT DISTINCT src AS Source, dst AS Target, 'Directed' AS Type FROM follow "
        "WHERE src IN (SELECT fan FROM sample) OR dst IN (SELECT fan FROM sample)")
    q["job_comu"] = q["id_list_edges"]
    q["follow_documents"] = q["follow_scan"]
    q["graph_drawing_nodes"] = q["graph_nodes_export"].replace(
        _with("orders"), _with("full"))
    q["graph_drawing_edges"] = _with("full") + " SELECT src, dst FROM follow"
    q["fan_positions"] = (
        _with("full") + " SELECT v.id, v.name, v.intro, f.fans, "
        "row_number() OVER (ORDER BY f.fans DESC, v.id) AS position FROM vertices v "
        "JOIN (SELECT dst, count(*) AS fans FROM follow GROUP BY dst) f ON f.dst = v.id")
    q["fan_page"] = (f"SELECT * FROM ({q['fan_positions']}) WHERE position BETWEEN 101 AND 150 "
                     "ORDER BY position")

    def lines(key: str, source: str) -> str:
        """Lists of a thousand members, by id; ``source`` gives key, id and the text of a member."""
        return (f" SELECT {key}, chunk_no, count(*) AS n, "
                f"CASE WHEN chunk_no = 0 THEN CAST({key} AS VARCHAR) || '->' ELSE ',' END || "
                f"string_agg(member, ',' ORDER BY id) AS line FROM (SELECT {key}, id, member, "
                f"(row_number() OVER (PARTITION BY {key} ORDER BY id) - 1) // 1000 AS chunk_no "
                f"FROM ({source})) GROUP BY {key}, chunk_no")

    q["community_member_lines"] = _with("orders", CC_CTES, recursive=True) + lines(
        "component", "SELECT l.component, l.id, v.name AS member FROM labels l "
        "JOIN vertices v ON v.id = l.id")
    q["lpa_member_lines"] = _with("full", LPA_CTES, recursive=True) + lines(
        "label", "SELECT l.label, l.id, CAST(l.id AS VARCHAR) AS member FROM labels l "
        "JOIN lsizes s ON s.label = l.label WHERE s.size > 10")
    q["edge_lookup"] = q["id_list_edges"]
    q["components_of_a_stream"] = q["connected_components_sparse"]
    q["job_community"] = q["job_community_documents"] = q["community_edges"]
    q["job_top_k_up_documents"] = q["top_influence"]
    return q
