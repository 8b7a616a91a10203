"""SQL for the registered queries."""

from __future__ import annotations

_RAW = """raw AS (SELECT c_custkey, c_name, c_acctbal, c_nationkey, CASE c_custkey % 6 WHEN 0 THEN c_nationkey::VARCHAR WHEN 1 THEN '00' || c_nationkey
  WHEN 2 THEN c_nationkey || '.0' WHEN 3 THEN '  +' || c_nationkey || ' ' WHEN 4 THEN '   ' ELSE ' A' || c_nationkey END AS code FROM customer),
sector AS (SELECT *, CASE WHEN trim(code) = '' THEN NULL WHEN regexp_full_match(trim(code), '[+-]?[0-9]+(\\.0+)?')
  THEN lpad((regexp_extract(trim(code), '[0-9]+')::BIGINT)::VARCHAR, greatest(2, len((regexp_extract(trim(code), '[0-9]+')::BIGINT)::VARCHAR))::INTEGER, '0') ELSE trim(code) END AS sector FROM raw)"""

_Z = """z AS (SELECT lpad((s_nationkey + 1)::VARCHAR, 2, '0') AS source, lpad((c_nationkey + 1)::VARCHAR, 2, '0') AS target,
  sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""

_X = f"""{_Z},
x AS (SELECT lpad((n_nationkey + 1)::VARCHAR, 2, '0') AS sector,
  (coalesce((SELECT sum(cents) FROM z WHERE target = lpad((n_nationkey + 1)::VARCHAR, 2, '0')), 0)
   + coalesce((SELECT sum(greatest(round(c_acctbal * 100), 0)::BIGINT) FROM customer WHERE c_nationkey = n_nationkey), 0) + 100)::BIGINT AS cents FROM nation)"""

# reach: for each sector the set of sectors that it reaches, as bits
_MWAS = f"""{_Z},
n AS (SELECT DISTINCT s, dense_rank() OVER (ORDER BY s) - 1 AS i FROM (SELECT source AS s FROM z UNION SELECT target FROM z)),
e AS (SELECT source, target, cents, a.i::INTEGER AS u, b.i::INTEGER AS v, row_number() OVER (ORDER BY cents DESC, source, target) AS k
  FROM z JOIN n a ON a.s = source JOIN n b ON b.s = target WHERE cents > 0 AND source <> target),
f AS (SELECT 0::BIGINT AS k, (SELECT list(1::BIGINT << i::INTEGER ORDER BY i) FROM n) AS reach, false AS kept
  UNION ALL SELECT e.k, CASE WHEN (f.reach[e.v + 1] >> e.u) & 1 = 1 THEN f.reach
    ELSE list_transform(f.reach, lambda x: CASE WHEN (x >> e.u) & 1 = 1 THEN x | f.reach[e.v + 1] ELSE x END) END, (f.reach[e.v + 1] >> e.u) & 1 = 0
  FROM f JOIN e ON e.k = f.k + 1),
kept AS (SELECT source, target, cents FROM e JOIN f USING (k) WHERE kept)"""

_ARCS = """way_key AS (SELECT DISTINCT (l_orderkey * 7 + l_linenumber) % 882 AS k FROM lineitem),
hop AS (SELECT i, j, h, i + h AS i2, j + 1 - h AS j2 FROM (SELECT k // 2 // 21 AS i, k // 2 % 21 AS j, k % 2 AS h FROM way_key)),
arc AS (SELECT i * 21 + j AS u, i2 * 21 + j2 AS v, i * 50.0::DOUBLE AS ax, j * 50.0::DOUBLE AS ay, i2 * 50.0::DOUBLE AS ex, j2 * 50.0::DOUBLE AS ey
  FROM hop WHERE i2 < 21 AND j2 < 21 AND (i * 7 + j * 3 + h * 5) % 11 <> 0 AND (i >= 17 AND j >= 17) = (i2 >= 17 AND j2 >= 17)),
vert AS (SELECT vid, (vid // 21) * 50.0::DOUBLE AS x, (vid % 21) * 50.0::DOUBLE AS y FROM (SELECT u AS vid FROM arc UNION SELECT v FROM arc)),
arcs AS (SELECT row_number() OVER (ORDER BY u, v) - 1 AS arc_id, u, v, 50.0::DOUBLE AS length, ax, ay, ex, ey FROM arc)"""

_POI = """kind AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)),
poi AS (SELECT event_id::VARCHAR AS point_id, lpad(k::VARCHAR, 2, '0') AS type, user_id, event_id,
  (((user_id * 37 + k * 3) % 20) * 50 + (event_id * 13) % 7)::DOUBLE AS x, (((user_id * 53 + k * 5) % 20) * 50 + (event_id * 29) % 7)::DOUBLE AS y
  FROM events JOIN kind USING (event_type))"""

_SNAP = f"""{_ARCS},
{_POI},
spot AS (SELECT DISTINCT x AS px, y AS py FROM poi),
t AS (SELECT px, py, arc_id, u, v, length, ax, ay, ex, ey, greatest(0, least(1, ((px - ax) * (ex - ax) + (py - ay) * (ey - ay)) / ((ex - ax) ** 2 + (ey - ay) ** 2))) AS t FROM spot, arcs),
d AS (SELECT *, sqrt((px - (ax + t * (ex - ax))) ** 2 + (py - (ay + t * (ey - ay))) ** 2) AS d FROM t),
best AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY px, py ORDER BY d, arc_id) = 1),
snap AS (SELECT p.*, arc_id, u, v, length, t * length AS off, d FROM poi p JOIN best ON px = x AND py = y),
keyed AS (SELECT *, CASE WHEN off <= 0 OR off >= length THEN 0 ELSE 1 END AS kind, CASE WHEN off <= 0 THEN u WHEN off >= length THEN v ELSE u END AS a,
  CASE WHEN off <= 0 OR off >= length THEN -1 ELSE v END AS b, CASE WHEN off <= 0 OR off >= length THEN 0 ELSE off END AS o FROM snap),
place AS (SELECT type, row_number() OVER (PARTITION BY type ORDER BY kind, a, b, o) - 1 AS position, kind, a, b, o, weight
  FROM (SELECT type, kind, a, b, o, count(*) AS weight FROM keyed GROUP BY ALL))"""

# road distance of all pairs of vertices within the radius of 60: one arc at most lies between two vertices
_PAIRS = f"""{_SNAP},
att AS (SELECT type, position, a AS node, 0.0 AS along FROM place WHERE kind = 0 UNION ALL SELECT type, position, a, o FROM place WHERE kind = 1
  UNION ALL SELECT type, position, b, 50.0 - o FROM place WHERE kind = 1),
vv AS (SELECT vid AS s, vid AS t, 0.0 AS d FROM vert UNION ALL SELECT u, v, length FROM arcs UNION ALL SELECT v, u, length FROM arcs),
through AS (SELECT l.type, l.position AS i, r.position AS j, l.along + vv.d + r.along AS d FROM att l JOIN vv ON vv.s = l.node JOIN att r ON r.node = vv.t AND r.type = l.type
  WHERE l.position < r.position AND l.along + vv.d + r.along <= 60),
same AS (SELECT l.type, l.position AS i, r.position AS j, abs(l.o - r.o) AS d FROM place l JOIN place r ON l.type = r.type AND l.kind = 1 AND r.kind = 1 AND l.a = r.a AND l.b = r.b AND l.position < r.position),
pairs AS (SELECT type, i, j, min(d) AS d FROM (SELECT * FROM through UNION ALL SELECT * FROM same WHERE d <= 60) GROUP BY type, i, j)"""

_CORE = f"""{_PAIRS},
both_ AS (SELECT type, i, j, d FROM pairs UNION ALL SELECT type, j, i, d FROM pairs),
within_ AS (SELECT b.type, b.i, b.d, sum(q.weight) OVER (PARTITION BY b.type, b.i ORDER BY b.d RANGE UNBOUNDED PRECEDING) AS w FROM both_ b JOIN place q ON q.type = b.type AND q.position = b.j),
core AS (SELECT p.type, p.position, CASE WHEN p.weight >= 5 THEN 0.0 ELSE (SELECT min(d) FROM within_ x WHERE x.type = p.type AND x.i = p.position AND x.w + p.weight >= 5) END AS core FROM place p)"""

# shortest distances by rounds: no path has more than 90 arcs here; labels fall until they stay
_SSSP = f"""{_ARCS},
way AS (SELECT u AS a, v AS b, length AS w FROM arcs UNION ALL SELECT v, u, length FROM arcs)"""

_GIVEN = f"""{_SNAP},
comp AS (SELECT vid, NOT (vid // 21 >= 17 AND vid % 21 >= 17) AS main FROM vert),
own AS (SELECT k.*, k.user_id % 4 + CASE WHEN comp.main THEN 0 ELSE 4 END AS cluster FROM keyed k JOIN comp ON comp.vid = k.u),
cut AS (SELECT arc_id, o, 441 + row_number() OVER (ORDER BY arc_id, o) - 1 AS node FROM (SELECT DISTINCT arc_id, off AS o FROM own WHERE kind = 1)),
stop AS (SELECT arc_id, o, node FROM cut UNION ALL SELECT arc_id, 0, u FROM arcs WHERE arc_id IN (SELECT arc_id FROM cut) UNION ALL SELECT arc_id, length, v FROM arcs WHERE arc_id IN (SELECT arc_id FROM cut)),
piece AS (SELECT node AS a, lead(node) OVER w AS b, lead(o) OVER w - o AS w FROM stop WINDOW w AS (PARTITION BY arc_id ORDER BY o)),
edge AS (SELECT a, b, w FROM piece WHERE b IS NOT NULL UNION ALL SELECT u, v, length FROM arcs WHERE arc_id NOT IN (SELECT arc_id FROM cut))"""

_CELLS = """cells AS (SELECT DISTINCT type, cluster, (type::INTEGER + 1) % 2 AS level, floor(x / (400 / ((type::INTEGER + 1) % 2 + 1)))::BIGINT AS ix, floor(y / (400 / ((type::INTEGER + 1) % 2 + 1)))::BIGINT AS iy FROM own),
dag AS (SELECT * FROM (VALUES ('01', '02', 0.5::DOUBLE), ('02', '03', 0.25::DOUBLE), ('01', '05', 0.125::DOUBLE), ('04', '02', 2.0::DOUBLE)) x(source_type, target_type, coefficient)),
overlap AS (SELECT DISTINCT d.source_type, a.cluster AS source_cluster, d.target_type, b.cluster AS target_cluster, d.coefficient
  FROM dag d JOIN cells a ON a.type = d.source_type JOIN cells b ON b.type = d.target_type
   AND (a.ix >> greatest(a.level - b.level, 0)) = (b.ix >> greatest(b.level - a.level, 0)) AND (a.iy >> greatest(a.level - b.level, 0)) = (b.iy >> greatest(b.level - a.level, 0)))"""

_SCORED = f"""{_POI},
scored AS (SELECT point_id, type, user_id % 4 AS cluster, (event_id % 997)::DOUBLE AS distance, (1 + user_id % 4)::DOUBLE AS centrality FROM poi),
p90 AS (SELECT type, cluster, quantile_cont(distance, 0.9) AS p90 FROM scored GROUP BY ALL)"""

ORACLES: dict[str, str] = {
    "sector_normalize": f"WITH {_RAW} SELECT c_custkey AS canonical_id, sector FROM sector",
    "classification_column_choice": f"WITH {_RAW} SELECT CASE WHEN count(sector) >= count(CASE WHEN c_custkey % 2 = 0 THEN sector END) THEN 'io80_code' ELSE 'io80_map_code' END AS chosen FROM sector",
    "point_prepare": f"""WITH {_RAW} SELECT c_custkey::VARCHAR AS canonical_id, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_name END, c_custkey::VARCHAR) AS canonical_name,
        sector AS type, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM sector WHERE sector IS NOT NULL""",
    "io_transactions_long": f"WITH {_Z} SELECT * FROM z",
    "io_total_output": f"WITH {_X} SELECT * FROM x",
    "io_matrix_wide": f"WITH {_Z} SELECT source, " + ", ".join(f"sum(cents) FILTER (target = '{t}')::BIGINT AS \"{t}\"" for t in (f"{i:02d}" for i in range(1, 26))) + " FROM z GROUP BY source",
    "technical_coefficients": f"WITH {_X} SELECT source, target, round(z.cents::DOUBLE / x.cents::DOUBLE * 1e9)::BIGINT AS billionths FROM z JOIN x ON x.sector = z.target",
    "io_candidate_edges": f"WITH {_Z} SELECT source, target, cents FROM z WHERE cents > 0 AND source <> target",
    "mwas_fast_edges": f"WITH RECURSIVE {_MWAS} SELECT source, target, cents FROM kept",
    "io_weight_audit": f"""WITH RECURSIVE {_MWAS}, s AS (SELECT sum(cents) AS w, count(*) AS n, coalesce(sum(cents) FILTER (source = target), 0) AS l FROM z WHERE cents > 0), k AS (SELECT sum(cents) AS w, count(*) AS n FROM kept)
        SELECT 'fast_greedy' AS method, s.w::BIGINT AS source_weight, k.w::BIGINT AS retained_weight, (s.w - k.w)::BIGINT AS removed_weight, s.l::BIGINT AS self_loop_weight,
        s.n AS source_edges, k.n AS retained_edges, s.n - k.n AS removed_edges FROM s, k""",
    "io_dag_reweighted": f"""WITH RECURSIVE {_MWAS.replace(_Z, _X)} SELECT source AS source_type, target AS target_type, kept.cents, round(kept.cents::DOUBLE / x.cents::DOUBLE * 1e9)::BIGINT AS billionths, 'fast' AS mwas_method
        FROM kept JOIN x ON x.sector = target""",
    "road_vertices": f"WITH {_ARCS} SELECT vid, x, y FROM vert",
    "road_arcs": f"WITH {_ARCS} SELECT arc_id, u, v, length FROM arcs",
    "road_components": f"WITH {_ARCS} SELECT CASE WHEN vid // 21 >= 17 AND vid % 21 >= 17 THEN 17 * 21 + 17 ELSE 0 END AS component, count(*) AS vertices FROM vert GROUP BY 1",
    "snap_points": f"WITH {_SNAP} SELECT point_id, arc_id, round(off, 6) AS snap_offset, round(d, 6) AS snap_distance FROM snap",
    "distinct_positions": f"WITH {_SNAP} SELECT type, position, kind, a, b, o::DOUBLE AS off, weight FROM place",
    "augment_nodes": f"""WITH {_SNAP}, cut AS (SELECT DISTINCT arc_id, off AS o FROM keyed WHERE kind = 1)
        SELECT vid AS node, x, y FROM vert UNION ALL
        SELECT 441 + row_number() OVER (ORDER BY arc_id, o) - 1, round(ax + o / 50 * (ex - ax), 6), round(ay + o / 50 * (ey - ay), 6) FROM cut JOIN arcs USING (arc_id)""",
    "augment_edges": f"""WITH {_SNAP}, cut AS (SELECT arc_id, o, 441 + row_number() OVER (ORDER BY arc_id, o) - 1 AS node FROM (SELECT DISTINCT arc_id, off AS o FROM keyed WHERE kind = 1)),
        stop AS (SELECT arc_id, o, node FROM cut UNION ALL SELECT arc_id, 0, u FROM arcs WHERE arc_id IN (SELECT arc_id FROM cut) UNION ALL SELECT arc_id, length, v FROM arcs WHERE arc_id IN (SELECT arc_id FROM cut)),
        piece AS (SELECT arc_id, node, lead(node) OVER w AS nxt, lead(o) OVER w - o AS length FROM stop WINDOW w AS (PARTITION BY arc_id ORDER BY o))
        SELECT least(node, nxt) AS u, greatest(node, nxt) AS v, round(length, 6) AS length, arc_id AS parent_edge_id FROM piece WHERE nxt IS NOT NULL
        UNION ALL SELECT u, v, length, arc_id FROM arcs WHERE arc_id NOT IN (SELECT arc_id FROM cut)""",
    "same_arc_pairs": f"""WITH {_SNAP} SELECT l.type, l.position AS i, r.position AS j, abs(l.o - r.o)::DOUBLE AS d FROM place l JOIN place r
        ON l.type = r.type AND l.kind = 1 AND r.kind = 1 AND l.a = r.a AND l.b = r.b AND l.position < r.position WHERE abs(l.o - r.o) <= 5""",
    "neighbor_pairs": f"WITH {_PAIRS} SELECT type, i, j, d::DOUBLE AS d FROM pairs",
    "core_distance": f"WITH {_CORE} SELECT type, position, core::DOUBLE AS core FROM core",
    "mutual_reachability": f"WITH {_CORE} SELECT p.type, i, j, greatest(x.core, y.core, d)::DOUBLE AS m FROM pairs p JOIN core x ON x.type = p.type AND x.position = i JOIN core y ON y.type = p.type AND y.position = j WHERE x.core IS NOT NULL AND y.core IS NOT NULL",
    "overlap_pairs": f"WITH {_GIVEN}, {_CELLS} SELECT source_type, source_cluster, target_type, target_cluster FROM overlap",
    "node_ids": "SELECT p_partkey, 'type=' || url_encode(p_type) || '::cluster=' || (p_partkey % 7) AS node_id FROM part",
    "cluster_p90": f"WITH {_SCORED} SELECT type, cluster, round(p90, 6) AS p90 FROM p90",
    "tempered_scores": f"""WITH {_SCORED} SELECT point_id, type, cluster, round(least(distance / greatest(p90, 1), 1), 9) AS q, round(centrality * (1 - 0.15 * least(distance / greatest(p90, 1), 1)), 9) AS score
        FROM scored JOIN p90 USING (type, cluster)""",
    "invariant_checks": f"""WITH {_SCORED}, k AS (SELECT DISTINCT type, cluster FROM scored),
        c AS (SELECT type, cluster, (type <> '03' OR cluster <> 1)::BIGINT AS n_centers, ((type <> '04' OR cluster <> 2)::BIGINT + (type = '05' AND cluster = 0)::BIGINT) AS n_partitions FROM k)
        SELECT type, cluster, n_centers, n_partitions FROM c WHERE n_centers <> 1 OR n_partitions <> 1""",
}

#: A spanning forest has as many edges of a distance as there are components fewer with the edges of that distance than without.
_FOREST = f"""{_CORE}, pair AS (SELECT p.type, i, j, greatest(x.core, y.core, d)::DOUBLE AS m FROM pairs p JOIN core x ON x.type = p.type AND x.position = i JOIN core y ON y.type = p.type AND y.position = j
  WHERE x.core IS NOT NULL AND y.core IS NOT NULL),
way2 AS (SELECT type, i AS a, j AS b, m FROM pair UNION ALL SELECT type, j, i, m FROM pair), ends AS (SELECT DISTINCT type, a AS node FROM way2), level AS (SELECT DISTINCT type, m AS t FROM pair),
part(type, t, node, l) USING KEY (type, t, node) AS (SELECT type, t, node, node AS l FROM ends JOIN level USING (type)
  UNION SELECT x.type, x.t, x.b, min(x.l) FROM (SELECT part.type, part.t, way2.b, part.l FROM part JOIN way2 ON way2.type = part.type AND way2.a = part.node AND way2.m <= part.t) x
  JOIN recurring.part r ON r.type = x.type AND r.t = x.t AND r.node = x.b WHERE x.l < r.l GROUP BY x.type, x.t, x.b),
many AS (SELECT type, t, count(*) AS n, count(*) FILTER (l = node) AS k FROM part GROUP BY type, t),
merged AS (SELECT type, t, coalesce(lag(k) OVER (PARTITION BY type ORDER BY t), n) - k AS edges FROM many)"""
ORACLES["spanning_forest_weight"] = f"WITH RECURSIVE {_FOREST} SELECT type, sum(edges)::BIGINT AS edges, round(sum(edges * t), 6) AS weight FROM merged GROUP BY type"
#: Components of at least five points by level of distance; a cluster is a chain of them, born where one falls apart into several.
_TREE = f"""{_FOREST}, step AS (SELECT type, t, row_number() OVER (PARTITION BY type ORDER BY t) AS k FROM level),
node AS (SELECT p.type, p.position, p.weight, core FROM place p JOIN core USING (type, position)),
lab AS (SELECT type, 0 AS k, position, position AS l, weight, core FROM node
  UNION ALL SELECT n.type, s.k, n.position, coalesce(q.l, n.position), n.weight, n.core FROM node n JOIN step s USING (type) LEFT JOIN part q ON q.type = n.type AND q.t = s.t AND q.node = n.position),
comp AS (SELECT type, k, l, sum(weight) AS n, min(position) AS first FROM lab GROUP BY type, k, l HAVING sum(weight) >= 5),
last AS (SELECT type, max(k) AS k FROM lab GROUP BY type),
hang AS (SELECT c.type, c.k, c.l, c.n, c.first, up.l AS ul FROM comp c LEFT JOIN lab up ON up.type = c.type AND up.k = c.k + 1 AND up.position = c.first),
falls AS (SELECT type, k + 1 AS k, ul AS l, count(*) AS n FROM hang WHERE ul IS NOT NULL GROUP BY type, k, ul),
chain AS (SELECT h.type, h.k, h.l, h.k AS sk, h.l AS sl, 1 / s.t AS birth FROM hang h JOIN falls f ON f.type = h.type AND f.k = h.k + 1 AND f.l = h.ul AND f.n > 1 JOIN step s ON s.type = h.type AND s.k = h.k + 1
  UNION ALL SELECT h.type, h.k, h.l, h.k, h.l, 0 FROM hang h JOIN last USING (type, k) WHERE (SELECT count(*) FROM comp c WHERE c.type = h.type AND c.k = h.k) > 1
  UNION ALL SELECT h.type, h.k, h.l, c.sk, c.sl, c.birth FROM chain c JOIN falls f ON f.type = c.type AND f.k = c.k AND f.l = c.l AND f.n = 1 JOIN hang h ON h.type = c.type AND h.k = c.k - 1 AND h.ul = c.l),
leave AS (SELECT c.type, c.sk, c.sl, c.birth, p.weight, CASE WHEN c.k > 0 THEN 1 / s.t WHEN p.core > 0 THEN 1 / p.core ELSE 'Infinity'::DOUBLE END AS gone
  FROM chain c JOIN lab p ON p.type = c.type AND p.k = c.k AND p.l = c.l LEFT JOIN step s ON s.type = c.type AND s.k = c.k
  LEFT JOIN lab below ON below.type = p.type AND below.k = p.k - 1 AND below.position = p.position
  LEFT JOIN chain d ON d.type = c.type AND d.k = c.k - 1 AND d.l = below.l AND d.sk = c.sk AND d.sl = c.sl WHERE d.l IS NULL)"""
ORACLES["condensed_tree"] = f"""WITH RECURSIVE {_TREE} SELECT x.type, c.first, c.n::BIGINT AS members, round(x.birth, 9) AS birth, CASE WHEN isinf(sum((gone - x.birth) * weight)) THEN NULL ELSE round(sum((gone - x.birth) * weight), 6) END AS stability
  FROM leave x JOIN comp c ON c.type = x.type AND c.k = x.sk AND c.l = x.sl GROUP BY x.type, x.sk, x.sl, c.first, c.n, x.birth"""
ORACLES["polygon_overlap_pairs"] = """WITH p AS (SELECT printf('%02d', c_nationkey % 5 + 1) AS type, c_custkey::BIGINT AS cluster, c_custkey * 37 % 1000 AS x0, (c_custkey * c_custkey * 7 + c_custkey * 11) % 997 AS y0,
  1 + c_custkey % 17 AS w, 1 + c_custkey % 13 AS h FROM customer), dag AS (SELECT * FROM (VALUES ('01', '02'), ('02', '03'), ('01', '05'), ('04', '02')) d(s, t))
SELECT a.type AS source_type, a.cluster AS source_cluster, b.type AS target_type, b.cluster AS target_cluster FROM dag JOIN p a ON a.type = s JOIN p b ON b.type = t
WHERE least(a.x0 + a.w, b.x0 + b.w) > greatest(a.x0, b.x0) AND least(a.y0 + a.h, b.y0 + b.h) > greatest(a.y0, b.y0)"""

#: Distances from a set of sources by repeated relaxation, in a recursion that keeps one row for each key.
_FROM = """dist(source, node, d) USING KEY (source, node) AS (SELECT {source} AS source, {source} AS node, 0.0::DOUBLE AS d FROM {sources}
  UNION SELECT x.source, x.b, min(x.d) FROM (SELECT dist.source, way.b, dist.d + way.w AS d FROM dist JOIN way ON way.a = dist.node) x
  LEFT JOIN recurring.dist r ON r.source = x.source AND r.node = x.b WHERE r.d IS NULL OR x.d < r.d GROUP BY x.source, x.b)"""
ORACLES["sssp_distances"] = ORACLES["sssp_relaxed"] = f"WITH RECURSIVE {_SSSP}, src AS (SELECT * FROM (VALUES (0), (440)) x(id)), {_FROM.format(source='id', sources='src')} SELECT source::BIGINT AS source, node::BIGINT AS node, d AS distance FROM dist"

_WAY = "way AS (SELECT a, b, w FROM edge UNION ALL SELECT b, a, w FROM edge)"
_OWN = """pt AS (SELECT own.type, own.cluster, event_id AS point_id, CASE WHEN own.kind = 0 THEN own.a ELSE cut.node END AS node FROM own LEFT JOIN cut ON cut.arc_id = own.arc_id AND cut.o = own.off AND own.kind = 1)"""
_MEDIAN = f"""{_GIVEN}, {_OWN}, {_WAY}, src AS (SELECT DISTINCT node AS id FROM pt), {_FROM.format(source='id', sources='src')},
sums AS (SELECT type, cluster, dist.node AS node, sum(d) AS objective FROM pt JOIN dist ON dist.source = pt.node GROUP BY ALL),
med AS (SELECT type, cluster, min(node) AS node, min(objective) AS objective FROM (SELECT *, min(objective) OVER (PARTITION BY type, cluster) AS best FROM sums) WHERE objective <= best + 1e-9 GROUP BY ALL)"""
ORACLES |= {
    "network_median": f"WITH RECURSIVE {_MEDIAN} SELECT type, cluster, node AS center_network_node, round(objective, 6) AS objective FROM med",
    "point_median_distance": f"WITH RECURSIVE {_MEDIAN} SELECT pt.point_id::VARCHAR AS point_id, pt.type, pt.cluster, round(dist.d, 6) AS distance FROM pt JOIN med USING (type, cluster) JOIN dist ON dist.source = pt.node AND dist.node = med.node",
    "voronoi_node_owner": f"""WITH RECURSIVE {_GIVEN}, {_OWN}, {_WAY}, src AS (SELECT DISTINCT node AS id FROM pt), {_FROM.format(source='id', sources='src')},
        near AS (SELECT DISTINCT type, cluster, dist.node, dist.d FROM pt JOIN dist ON dist.source = pt.node)
        SELECT type, node, round(min(d), 6) AS distance, min(cluster) FILTER (d <= least_ + 1e-9) AS cluster FROM (SELECT *, min(d) OVER (PARTITION BY type, node) AS least_ FROM near) GROUP BY type, node""",
}
_XPARTS = f"""{_MEDIAN}, {_CELLS}, center AS (SELECT type, cluster, node FROM med), hub AS (SELECT DISTINCT node AS id FROM center), {_FROM.format(source='id', sources='hub').replace('dist', 'far')},
x AS (SELECT 'type=' || o.source_type || '::cluster=' || o.source_cluster AS source_id, 'type=' || o.target_type || '::cluster=' || o.target_cluster AS target_id, o.*, far.d
  FROM overlap o JOIN center a ON a.type = o.source_type AND a.cluster = o.source_cluster JOIN center b ON b.type = o.target_type AND b.cluster = o.target_cluster
  LEFT JOIN far ON far.source = a.node AND far.node = b.node)"""
ORACLES |= {
    "x_edges": f"WITH RECURSIVE {_XPARTS} SELECT source_id, target_id, coefficient AS technical_coefficient, d AS road_distance, coefficient * d AS edge_weight FROM x WHERE d IS NOT NULL",
    "disconnected_pairs": f"WITH RECURSIVE {_XPARTS} SELECT source_type, source_cluster, target_type, target_cluster, 'disconnected_centers' AS reason FROM x WHERE d IS NULL",
    "x_degrees": f"WITH RECURSIVE {_XPARTS} SELECT 'type=' || type || '::cluster=' || cluster AS node_id, (SELECT count(*) FROM x WHERE d IS NOT NULL AND target_type = type AND target_cluster = cluster) AS in_degree, (SELECT count(*) FROM x WHERE d IS NOT NULL AND source_type = type AND source_cluster = cluster) AS out_degree FROM center",
    "undirected_projection": f"WITH RECURSIVE {_XPARTS} SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, sum(coefficient * d) AS weight FROM x WHERE coefficient * d > 0 GROUP BY 1, 2",
    "spatial_summary": f"""WITH RECURSIVE {_XPARTS}, degree_of AS (SELECT type, cluster, (SELECT count(*) FROM x WHERE d IS NOT NULL AND ((target_type = type AND target_cluster = cluster) OR (source_type = type AND source_cluster = cluster))) AS g FROM center),
        type_size AS (SELECT type, count(*) AS n FROM center GROUP BY type), route AS (SELECT d FROM x WHERE d IS NOT NULL)
        SELECT (SELECT count(*) FROM type_size) AS types, (SELECT min(n) FROM type_size) AS clusters_min, (SELECT quantile_cont(n, 0.5) FROM type_size)::DOUBLE AS clusters_median, (SELECT max(n) FROM type_size) AS clusters_max,
        (SELECT max(g) FROM degree_of) AS degree_max, (SELECT avg(g) FROM degree_of) AS degree_mean, (SELECT count(*) FROM route) AS routes, (SELECT sum(d) FROM route) AS route_sum, (SELECT min(d) FROM route) AS route_min,
        (SELECT quantile_cont(d, 0.5) FROM route)::DOUBLE AS route_median, (SELECT max(d) FROM route) AS route_max""",
}
_SURFACE = f"""{_GIVEN}, {_OWN}, {_WAY}, src AS (SELECT DISTINCT node AS id FROM pt), {_FROM.format(source='id', sources='src')},
near AS (SELECT DISTINCT type, cluster, dist.node, dist.d FROM pt JOIN dist ON dist.source = pt.node),
owner AS (SELECT type, node, min(d) AS d, min(cluster) FILTER (d <= least_ + 1e-9) AS c FROM (SELECT *, min(d) OVER (PARTITION BY type, node) AS least_ FROM near) GROUP BY type, node),
pc AS (SELECT arc_id, node AS a, o AS o1, lead(node) OVER w AS b, lead(o) OVER w AS o2 FROM stop WINDOW w AS (PARTITION BY arc_id ORDER BY o)),
line AS (SELECT * FROM pc WHERE b IS NOT NULL UNION ALL SELECT arc_id, u, 0, v, length FROM arcs WHERE arc_id NOT IN (SELECT arc_id FROM cut)),
geo AS (SELECT a, b, o2 - o1 AS w, ax + o1 / 50 * (ex - ax) AS x1, ay + o1 / 50 * (ey - ay) AS y1, ax + o2 / 50 * (ex - ax) AS x2, ay + o2 / 50 * (ey - ay) AS y2 FROM line JOIN arcs USING (arc_id)),
grid AS (SELECT ix, iy, ix * 50 + 25.0 AS px, iy * 50 + 25.0 AS py FROM range(20) a(ix), range(20) b(iy)),
hit AS (SELECT ix, iy, a, b, w, px, py, x1, y1, x2, y2, greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t FROM grid, geo),
far AS (SELECT *, sqrt((px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2) AS r FROM hit),
both_ends AS (SELECT far.*, p.type, p.c AS ca, p.d AS da, q.c AS cb, q.d AS db FROM far JOIN owner p ON p.node = a JOIN owner q ON q.node = b AND q.type = p.type),
tied AS (SELECT *, t * w AS off, greatest(0, least(w, (db + w - da) / 2)) AS split FROM both_ends QUALIFY r <= min(r) OVER (PARTITION BY type, ix, iy) + 1e-9),
cell AS (SELECT type, ix, iy, min(CASE WHEN off <= 1e-10 THEN ca WHEN w - off <= 1e-10 THEN cb WHEN ca = cb THEN ca WHEN off < split - 1e-10 THEN ca WHEN off > split + 1e-10 THEN cb ELSE least(ca, cb) END) AS cluster FROM tied GROUP BY ALL)"""
_EIGEN = f"""{_Z}, n AS (SELECT s, row_number() OVER (ORDER BY s) AS i FROM (SELECT source AS s FROM z UNION SELECT target FROM z)),
p AS (SELECT a.i AS i, b.i AS j, sum(cents) / 1e9 AS v FROM z JOIN n a ON a.s IN (source, target) JOIN n b ON b.s IN (source, target) AND b.i <> a.i WHERE source <> target GROUP BY ALL),
m AS (SELECT list(r ORDER BY i) AS w FROM (SELECT a.i AS i, list(coalesce(v, 0)::DOUBLE ORDER BY b.i) AS r FROM n a CROSS JOIN n b LEFT JOIN p ON p.i = a.i AND p.j = b.i GROUP BY a.i)),
x AS (SELECT 0 AS k, (SELECT list(1.0::DOUBLE) FROM n) AS x UNION ALL
  SELECT k + 1, list_transform(y, lambda v: v / sqrt(list_dot_product(y, y))) FROM (SELECT k, list_transform(range(1, len(x) + 1), lambda i: x[i] + list_dot_product(w[i], x)) AS y FROM x, m WHERE k < 400))"""
ORACLES |= {
    "voronoi_cells": f"WITH RECURSIVE {_SURFACE} SELECT type, cluster, 0 AS level, ix, iy, 2500.0::DOUBLE AS area FROM cell",
    "partition_area": f"WITH RECURSIVE {_SURFACE} SELECT type, cluster, 2500.0::DOUBLE * count(*) AS area FROM cell GROUP BY type, cluster",
    "eigenvector_centrality": f"WITH RECURSIVE {_EIGEN} SELECT s AS node_id, round(x[i], 6) AS centrality FROM x, n WHERE k = 400",
    "acyclicity_check": f"""WITH RECURSIVE {_MWAS}, r AS (SELECT 'source' AS graph, source AS a, target AS b FROM e UNION SELECT 'kept', source, target FROM kept
        UNION SELECT r.graph, r.a, g.b FROM r JOIN (SELECT 'source' AS graph, source AS a, target AS b FROM e UNION ALL SELECT 'kept', source, target FROM kept) g ON g.graph = r.graph AND g.a = r.b)
        SELECT graph, NOT bool_or(a = b) AS acyclic FROM r GROUP BY graph""",
}

# in a slab between neighbouring left and right ends, boxes are intervals, whose union is a sum of gaps and overlaps
_BOXES = """p AS (SELECT printf('%02d', c_nationkey % 5 + 1) AS type, c_custkey * 37 % 1000 AS x0, (c_custkey * c_custkey * 7 + c_custkey * 11) % 997 AS y0, 1 + c_custkey % 17 AS w, 1 + c_custkey % 13 AS h FROM customer),
e AS (SELECT type, x0 AS x FROM p UNION SELECT type, x0 + w FROM p), slab AS (SELECT type, x, lead(x) OVER (PARTITION BY type ORDER BY x) AS nx FROM e),
cover AS (SELECT s.type, x, nx, y0, y0 + h AS y1, max(y0 + h) OVER (PARTITION BY s.type, x ORDER BY y0, y0 + h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM slab s JOIN p ON p.type = s.type AND p.x0 <= s.x AND p.x0 + p.w >= s.nx),
covered AS (SELECT type, sum((nx - x) * greatest(0, y1 - greatest(y0, coalesce(before, y0))))::DOUBLE AS area FROM cover GROUP BY type)"""
ORACLES["polygon_union_area"] = f"WITH {_BOXES} SELECT type, area FROM covered"
ORACLES["polygon_union_outline"] = f"WITH {_BOXES} SELECT type, area, true AS valid FROM covered"
# the box around a site is cut by the line between the site and one neighbour after another
ORACLES["planar_voronoi_area"] = """WITH RECURSIVE s AS (SELECT printf('%02d', s_nationkey % 5 + 1) AS type, s_suppkey::BIGINT AS cluster, s_suppkey::DOUBLE AS x, (s_suppkey * 7919 % 1009)::DOUBLE AS y FROM supplier),
w AS (SELECT max(x) + 1 AS x1 FROM s),
n AS (SELECT a.type, a.cluster, row_number() OVER (PARTITION BY a.type, a.cluster ORDER BY (b.x - a.x) ** 2 + (b.y - a.y) ** 2, b.cluster) AS k, b.x - a.x AS dx, b.y - a.y AS dy FROM s a JOIN s b ON a.type = b.type AND a.cluster <> b.cluster),
r AS (SELECT type, cluster, 0::BIGINT AS k, [{'x': 0 - x, 'y': -1 - y}, {'x': x1 - x, 'y': -1 - y}, {'x': x1 - x, 'y': 1010 - y}, {'x': 0 - x, 'y': 1010 - y}] AS ring FROM s, w
  UNION ALL
  SELECT r.type, r.cluster, n.k, flatten(list_transform(range(1, len(ring) + 1), lambda i: list_filter([
    CASE WHEN dx * ring[i].x + dy * ring[i].y <= (dx * dx + dy * dy) / 2 THEN ring[i] END,
    CASE WHEN (dx * ring[i].x + dy * ring[i].y - (dx * dx + dy * dy) / 2) * (dx * ring[i % len(ring) + 1].x + dy * ring[i % len(ring) + 1].y - (dx * dx + dy * dy) / 2) < 0 THEN
      {'x': ring[i].x + (dx * ring[i].x + dy * ring[i].y - (dx * dx + dy * dy) / 2) / (dx * (ring[i].x - ring[i % len(ring) + 1].x) + dy * (ring[i].y - ring[i % len(ring) + 1].y)) * (ring[i % len(ring) + 1].x - ring[i].x),
       'y': ring[i].y + (dx * ring[i].x + dy * ring[i].y - (dx * dx + dy * dy) / 2) / (dx * (ring[i].x - ring[i % len(ring) + 1].x) + dy * (ring[i].y - ring[i % len(ring) + 1].y)) * (ring[i % len(ring) + 1].y - ring[i].y)} END
    ], lambda p: p IS NOT NULL))) FROM r JOIN n ON n.type = r.type AND n.cluster = r.cluster AND n.k = r.k + 1),
f AS (SELECT type, cluster, arg_max(ring, k) AS ring FROM r GROUP BY type, cluster)
SELECT type, cluster, round(list_sum(list_transform(range(1, len(ring) + 1), lambda i: ring[i].x * ring[i % len(ring) + 1].y - ring[i % len(ring) + 1].x * ring[i].y)) / 2, 6) AS area FROM f"""
