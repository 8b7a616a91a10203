import random

import pytest
from pyspark.sql import functions as F

from waylattice.operators import density, median, paths, points as pts, roads, scoring, surface, xgraph
from waylattice.plans.catalog import BOUNDARY


def lines(spark, *parts):
    return spark.createDataFrame([(i, 0, [{"x": float(x), "y": float(y)} for x, y in p]) for i, p in enumerate(parts)], "line_id long, part int, coords array<struct<x:double,y:double>>")


def points(spark, rows, t="01"):
    return spark.createDataFrame([(str(i), t, float(x), float(y)) for i, (x, y) in enumerate(rows)], "point_id string, type string, x double, y double")


def box(x0, y0, x1, y1):
    return [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]]


def inserted(spark, road, rows, clusters, t="01"):
    v, a = roads.build_network(road)
    p = points(spark, rows, t).withColumn("cluster", F.element_at(F.array(*map(F.lit, clusters)), F.col("point_id").cast("int") + 1).cast("long"))
    s = roads.materialize(roads.snap(p, v, a), "s")
    n, e, of = roads.augment(v, a, s)
    return n, e, roads.materialize(s.join(of, "point_id"), "p")


def test_snap_and_distance(spark):
    v, a = roads.build_network(lines(spark, [(0, 0), (10, 0), (20, 0)]))
    s = roads.snap(points(spark, [(2, 1), (18, -1)]), v, a).orderBy("point_id").collect()
    assert [r["snap_distance"] for r in s] == [1, 1]
    n, e, p = inserted(spark, lines(spark, [(0, 0), (10, 0), (20, 0)]), [(2, 1), (18, -1)], [0, 0])
    nodes = [r["node"] for r in p.orderBy("point_id").collect()]
    d = paths.distances(spark.createDataFrame([(nodes[0],)], "source long"), e).where(F.col("node") == nodes[1]).first()
    assert d["distance"] == 16


def test_reversed_duplicate_is_one_arc(spark):
    v, a = roads.build_network(lines(spark, [(0, 0), (10, 0)], [(10, 0), (0, 0)]))
    assert a.count() == 1 and v.count() == 2


def test_kernel_equals_relaxation(spark):
    rng = random.Random(3)
    arcs = {tuple(sorted(rng.sample(range(40), 2))): rng.uniform(1, 9) for _ in range(90)}
    e = spark.createDataFrame([(i, u, v, w) for i, ((u, v), w) in enumerate(arcs.items())], "arc_id long, u long, v long, length double")
    src = spark.createDataFrame([(0,), (7,)], "source long")
    for cutoff in (None, 12.0):
        a = {(r["source"], r["node"]): r["distance"] for r in paths.distances(src, e, cutoff).collect()}
        b = {(r["source"], r["node"]): r["distance"] for r in paths.relaxed(src, e, cutoff).collect()}
        assert a == b


def test_path_geometry(spark):
    e = spark.createDataFrame([(0, 0, 1, 100.0), (1, 1, 2, 100.0)], "arc_id long, u long, v long, length double")
    r = paths.paths_to(spark.createDataFrame([(0, 2), (1, 1), (0, 9)], "source long, target long"), e).collect()
    got = {(x["source"], x["target"]): (x["distance"], x["path"]) for x in r}
    assert got == {(0, 2): (200.0, [0, 1, 2]), (1, 1): (0.0, [1]), (0, 9): (None, None)}


def test_medians(spark):
    road = lines(spark, [(0, 0), (30, 0)])
    for xs, want in (((2, 3, 18), 3), ((2, 2, 2, 25), 2)):
        n, e, p = inserted(spark, road, [(x, 0) for x in xs], [0] * len(xs))
        m = median.cluster_medians(p, n, e).first()
        assert (m["x"], m["y"]) == (want, 0)
        d = median.median_distances(p, median.cluster_medians(p, n, e), e).agg(F.sum("distance_to_cluster_median")).first()[0]
        assert d == sum(abs(x - want) for x in xs)


def test_medians_equal_enumeration(spark, monkeypatch):
    """On a grid of streets, with the kernel and by relaxation, the bound around the hub loses no median."""
    rng = random.Random(5)
    road = lines(spark, *[[(10 * k, 10 * i) for k in range(5)] for i in range(5)], *[[(10 * i, 10 * k) for k in range(5)] for i in range(5)])
    rows = [(rng.randrange(41), 10 * rng.randrange(5)) for _ in range(24)]
    n, e, p = inserted(spark, road, rows, [i % 3 for i in range(24)])
    arcs = [(r["u"], r["v"], r["length"]) for r in e.collect()]
    ids = sorted({x for u, v, _ in arcs for x in (u, v)})
    d = {(a, b): 0.0 if a == b else float("inf") for a in ids for b in ids}
    for u, v, w in arcs:
        d[u, v] = d[v, u] = min(w, d[u, v])
    for k in ids:
        for a in ids:
            if d[a, k] < float("inf"):
                for b in ids:
                    d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    want = {}
    for c in range(3):
        at = [r["node"] for r in p.where(F.col("cluster") == c).collect()]
        sums = {v: sum(d[v, x] for x in at) for v in ids}
        want[c] = min(v for v in ids if sums[v] <= min(sums.values()) + 1e-9)
    for most in (paths.KERNEL_ARCS, 0):
        monkeypatch.setattr(paths, "KERNEL_ARCS", most)
        m = median.cluster_medians(p, n, e)
        assert {r["cluster"]: r["center_network_node"] for r in m.collect()} == want
        got = median.median_distances(p, m, e).select("cluster", "node", "distance_to_cluster_median").collect()
        assert len(got) == 24 and all(abs(x - d[want[c], v]) < 1e-9 for c, v, x in got)


def test_two_dense_groups(spark):
    v, a = roads.build_network(lines(spark, [(0, 0), (100, 0)]))
    xs = [*range(1, 6), *range(95, 100)]
    for order in (xs, xs[::-1]):
        s = roads.materialize(roads.snap(points(spark, [(x, 0) for x in order]), v, a), "s")
        places, of = roads.positions(s)
        out, summary, _ = density.cluster_by_type(s, places, of, a, density.ClusteringConfig(3, 2))
        got = {}
        for r in out.collect():
            got.setdefault(r["cluster"], set()).add(r["x"])
        assert set(got) == {0, 1} and {frozenset(x) for x in got.values()} == {frozenset(map(float, xs[:5])), frozenset(map(float, xs[5:]))}


def test_points_get_positions_and_nodes_without_meeting(spark, monkeypatch):
    v, a = roads.build_network(lines(spark, [(0, 0), (100, 0)], [(0, 50), (100, 50)]))
    s = roads.materialize(roads.snap(points(spark, [(k % 7 * 15, k % 2 * 50) for k in range(60)]), v, a), "s")
    places, of = roads.positions(s)
    assert places.count() == 14 and places.agg(F.sum("weight")).first()[0] == 60
    want = {r["point_id"]: r["position"] for r in of.collect()}, {r["point_id"]: r["node"] for r in roads.augment(v, a, s)[2].collect()}
    monkeypatch.setattr(roads, "SNAPPED_PLACES", 0)
    assert want[0] == {r["point_id"]: r["position"] for r in roads.positioned(s, places).collect()}
    assert want[1] == {r["point_id"]: r["node"] for r in roads.inserted(v, a, s)[2].collect()}
    monkeypatch.setattr(roads, "SNAPPED_PLACES", 200_000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, got in zip(("position", "node"), (roads.positioned(s, places), roads.inserted(v, a, s)[2]), strict=True):
            assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
            assert want[name == "node"] == {r["point_id"]: r[name] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_points_at_a_place_are_added_up_unsorted(spark, monkeypatch):
    v, a = roads.build_network(lines(spark, [(0, 0), (100, 0)]))
    s = roads.materialize(roads.snap(points(spark, [(k % 7, 0) for k in range(60)]), v, a), "s")
    plans, write = [], roads.materialize
    monkeypatch.setattr(roads, "materialize", lambda df, tag: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or write(df, tag))
    roads.positions(s)
    assert [x.strip(" +-:*") for x in plans[0].splitlines() if "Aggregate" in x][-1].startswith("HashAggregate")


def test_positioned_points_cluster_as_with_a_table(spark):
    v, a = roads.build_network(lines(spark, [(0, 0), (100, 0)]))
    s = roads.materialize(roads.snap(points(spark, [(x, 0) for x in [*range(1, 6), *range(95, 100)]]), v, a), "s")
    places, of = roads.positions(s)
    config = density.ClusteringConfig(3, 2)
    one, two = (density.cluster_by_type(p, places, o, a, config)[0].select("point_id", "position", "cluster", "membership") for p, o in ((s, of), (roads.positioned(s, places), None)))
    assert sorted(one.collect()) == sorted(two.collect())


@pytest.mark.parametrize("name", ["overlap_pairs", "distinct_positions"])
def test_queries_write_no_row_for_each_event(spark, monkeypatch, name):
    from pyspark.sql import DataFrameWriter

    from waylattice.plans.catalog import QUERIES

    written, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *args, **named: written.append(path) or write(self, path, *args, **named))
    QUERIES[name](spark, "/root/testdata/sf0.01")
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").count()
    assert written and all(spark.read.parquet(x).count() < events for x in written)


def test_sparse_line_is_noise(spark):
    v, a = roads.build_network(lines(spark, [(0, 0), (5000, 0)]))
    s = roads.materialize(roads.snap(points(spark, [(10 * i, 0) for i in range(400)]), v, a), "s")
    places, of = roads.positions(s)
    out, summary, _ = density.cluster_by_type(s, places, of, a, density.ClusteringConfig(max_distance=1.0, distance_mode="fixed"))
    assert out.where("cluster >= 0").count() == 0 and summary.first()["status"] == "fixed"
    with pytest.raises(paths.TooManyPairs):
        paths.neighbor_pairs(places, a, 1000.0, 10)


def test_forest_has_the_weight_of_kruskal(spark):
    rng = random.Random(1)
    e = [("a", i, j, float(rng.randint(1, 20))) for i in range(60) for j in range(i + 1, 60) if rng.random() < 0.3]
    sets, want = density.Sets(), 0.0
    for _, i, j, m in sorted(e, key=lambda r: r[3]):
        if sets.join(i, j):
            want += m
    assert density.spanning_forest(spark.createDataFrame(e, "type string, i long, j long, m double")).agg(F.sum("m")).first()[0] == want


def test_surface_area_and_ties(spark):
    n, e, p = inserted(spark, lines(spark, [(0, 0), (20, 0)]), [(2, 0), (18, 0)], [0, 1])
    cells = surface.territories(p, n, e, box(0, -2, 20, 2), surface.SurfaceConfig(1.0))
    area = {r["cluster"]: r["a"] for r in cells.groupBy("cluster").agg(F.sum("area").alias("a")).collect()}
    assert sum(area.values()) == 80 and area == {0: 40, 1: 40}
    tie = paths.nearest_sources(spark.createDataFrame([("01", 1, 0), ("01", 0, 2)], "type string, cluster long, node long"), spark.createDataFrame([(0, 0, 1, 5.0), (1, 1, 2, 5.0)], "arc_id long, u long, v long, length double"))
    assert {r["node"]: (r["distance"], r["cluster"]) for r in tie.collect()}[1] == (5.0, 0)


def test_surface_refines_and_gives_up(spark):
    n, e, p = inserted(spark, lines(spark, [(0, 0), (20, 0)]), [(1, 0), (2, 0)], [0, 1])
    with pytest.raises(ValueError, match="too coarse"):
        surface.territories(p, n, e, box(0, -2, 20, 2), surface.SurfaceConfig(100.0, max_refinements=0))
    cells = surface.territories(p, n, e, box(0, -2, 20, 2), surface.SurfaceConfig(16.0))
    assert cells.agg(F.min("level")).first()[0] >= 1 and cells.agg(F.sum("area")).first()[0] == 80


def test_unreached_component_has_no_surface(spark):
    n, e, p = inserted(spark, lines(spark, [(0, 0), (10, 0)], [(90, 0), (100, 0)]), [(5, 0)], [0])
    cells = surface.territories(p, n, e, box(0, -5, 100, 5), surface.SurfaceConfig(5.0))
    assert cells.agg(F.sum("area"), F.count_distinct("cluster")).first()[:] == (1000, 1)


def test_irregular_boundary_keeps_area(spark):
    triangle = [[[(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)]]]
    assert surface.grid(spark, triangle, 1.5, 100).agg(F.sum("area")).first()[0] == pytest.approx(50)
    with pytest.raises(ValueError):
        surface.grid(spark, BOUNDARY, 1.0, 100)


def test_x_edge_and_shared_solve(spark):
    n, e, p = inserted(spark, lines(spark, [(0, 0), (20, 0)]), [(2, 0), (18, 0)], [0, 0])
    nodes = {r["x"]: r["node"] for r in p.collect()}
    centers = spark.createDataFrame([("A", 0, nodes[2.0], 2.0, 0.0), ("B", 0, nodes[18.0], 18.0, 0.0)], "type string, cluster long, center_network_node long, x double, y double")
    dag = spark.createDataFrame([("A", "B", 3.0)], "source_type string, target_type string, technical_coefficient double")
    overlap = spark.createDataFrame([("A", 0, "B", 0)], "source_type string, source_cluster long, target_type string, target_cluster long")
    x_nodes, x_edges, apart = xgraph.cluster_graph(centers, dag, overlap, e)
    r = x_edges.first()
    assert (r["road_distance"], r["edge_weight"], apart.count(), x_nodes.count()) == (16, 48, 0, 2)


def test_centrality(spark):
    nodes = spark.createDataFrame([(x,) for x in "abc"], "node_id string")
    edge = lambda rows: spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "source_id string, target_id string, edge_weight double")
    c = {r["node_id"]: r["centrality"] for r in xgraph.centrality(nodes, edge([("a", "b", 2), ("b", "c", 3)])).collect()}
    assert c["b"] > c["c"] > c["a"] and sum(v * v for v in c.values()) == pytest.approx(1)
    d = {r["node_id"]: r["centrality"] for r in xgraph.centrality(nodes, edge([("a", "b", 2), ("b", "c", 3)]), tolerance=1e-4, local_edges=0).collect()}
    assert all(abs(c[k] - d[k]) < 1e-2 for k in c)
    z = xgraph.centrality(nodes, edge([("a", "b", 0), ("b", "c", 0)])).collect()
    assert all(r["centrality"] == pytest.approx(3**-0.5) for r in z)


def test_scores(spark):
    p = spark.createDataFrame([(str(i), "1", 0, float(d)) for i, d in enumerate((0, 10, 20, 30, 100))], "point_id string, type string, cluster long, distance_to_cluster_median double")
    c = spark.createDataFrame([("1", 0, 2.0)], "type string, cluster long, centrality double")
    s = {r["distance_to_cluster_median"]: r for r in scoring.tempered_scores(p, c).collect()}
    assert s[0]["cluster_distance_p90"] == 72 and s[0]["score"] == 2.0 and s[100]["score"] == pytest.approx(1.7) and s[100]["normalized_cluster_distance"] == 1
    assert {r["score"] for r in scoring.tempered_scores(p, c, 0.0).collect()} == {2.0}
    with pytest.raises(ValueError):
        scoring.tempered_scores(p, c.where("cluster > 0"))


def test_point_contracts(spark):
    p = spark.createDataFrame([(1, "1", "1.0", 0.0, 0.0), (2, None, "2", 1.0, 1.0)], "canonical_id long, io80_code string, io80_map_code string, x double, y double")
    assert pts.classification_column(p, "io80") == "io80_map_code"
    with pytest.raises(ValueError):
        pts.classification_column(p.withColumn("io80_map_code", F.lit("3")), "io80")
    got = pts.prepare_points(p, "io80").orderBy("canonical_id").collect()
    assert [(r["type"], r["canonical_name"]) for r in got] == [("01", "1"), ("02", "2")]
    old = spark.createDataFrame([("a", "1", 0, 5.0, "network_shortest_path")], "canonical_id string, type string, cluster long, network_distance_to_center double, point_center_distance_method string")
    assert pts.restart_points(old).first()["distance_to_cluster_median"] == 5
    with pytest.raises(ValueError):
        pts.restart_points(old.withColumn("point_center_distance_method", F.lit("other")))


def test_whole_queries_take_every_event(spark):
    from waylattice.plans.catalog import QUERIES

    d = "/root/testdata/sf0.01"
    rows = QUERIES["point_median_distance"](spark, d).collect()
    assert len({r["point_id"] for r in rows}) == len(rows) == spark.read.parquet(f"{d}/events.parquet").count()
    sums = {}
    for r in rows:
        sums[r["type"], r["cluster"]] = sums.get((r["type"], r["cluster"]), 0.0) + r["distance"]
    medians = {(r["type"], r["cluster"]): r["objective"] for r in QUERIES["network_median"](spark, d).collect()}
    # each point has its weight, and the corner has clusters of its own
    assert medians == pytest.approx(sums, abs=1e-2) and {c for _, c in medians} >= {0, 1, 2, 3} and max(c for _, c in medians) > 3
    areas = QUERIES["partition_area"](spark, d).collect()
    assert {(r["type"], r["cluster"]) for r in areas} <= medians.keys() and any(r["cluster"] > 3 for r in areas)
    assert any(r["cluster"] > 3 for r in QUERIES["voronoi_node_owner"](spark, d).select("cluster").distinct().collect())


def test_towns_have_every_event(spark):
    from waylattice.sources import derived

    d = "/root/testdata/sf0.01"
    towns = derived.towns(spark, d)
    assert towns.count() == towns.select("point_id").distinct().count() == spark.read.parquet(f"{d}/events.parquet").count()
    sizes = towns.select("type", (F.col("x") > 400).alias("town"), "x", "y").distinct().groupBy("type", "town").count().collect()
    assert {r["count"] for r in sizes} == {49}
