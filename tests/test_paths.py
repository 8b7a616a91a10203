"""Searches on graphs beyond the kernel's size equal the kernel's, ties included."""

import random

import pytest
from pyspark.sql import functions as F

from waylattice.operators import density, median, outputs, paths, roads, xgraph

EDGES = "aug_edge_id long, u long, v long, length double"


def lattice(n):
    """Equal arcs, so most pairs have many shortest paths; the last node is apart."""
    rows = [(i * n + j, i * n + j + 1) for i in range(n) for j in range(n - 1)] + [(i * n + j, i * n + j + n) for i in range(n - 1) for j in range(n)]
    return [(k, u, v, 50.0) for k, (u, v) in enumerate(rows)] + [(len(rows), n * n, n * n + 1, 1.0)]


def tangle(n, seed):
    rng = random.Random(seed)
    rows = [(k, rng.randrange(k + 1), k + 1, rng.choice([1.0, 2.0, 0.1, 1e-12])) for k in range(n)]
    return rows + [(n + k, *rng.sample(range(n), 2), rng.choice([1.0, 2.0, 0.3])) for k in range(n)]


@pytest.mark.parametrize("rows", [lattice(5), tangle(40, 1), tangle(40, 2)], ids=["lattice", "tangle", "tangle 2"])
def test_paths_by_relaxation(spark, rows, monkeypatch):
    edges = spark.createDataFrame(rows, EDGES)
    rng, nodes = random.Random(3), sorted({x for r in rows for x in r[1:3]})
    asked = [(rng.choice(nodes[:4]), rng.choice(nodes)) for _ in range(15)] + [(nodes[0], nodes[0]), (nodes[0], nodes[-1])]
    pairs = spark.createDataFrame(asked + asked[:2], "source long, target long")
    by_kernel = sorted(map(tuple, paths.paths_to(pairs, edges).collect()))
    monkeypatch.setattr(paths, "KERNEL_ARCS", 0)
    assert sorted(map(tuple, paths.paths_to(pairs, edges).select("source", "target", "distance", "path").collect())) == by_kernel
    want = sorted(r[:3] for r in by_kernel if r[2] is not None)
    assert sorted(map(tuple, paths.pair_distances(pairs, edges).select("source", "target", "distance").collect())) == want
    if rows[0][3] == 50.0:
        assert [r for r in by_kernel if r[1] == nodes[-1]][0][2:] == (None, None)


def test_targets_bound_what_is_relaxed(spark, monkeypatch):
    monkeypatch.setattr(paths, "PART_NODES", 16)
    edges = spark.createDataFrame([(k, k, k + 1, 1.0) for k in range(150)], EDGES)
    near = spark.createDataFrame([(0, 3), (0, 5), (100, 98)], "source long, target long")
    got = paths.relaxed(near, edges, targets=near)
    # no further than the part that the targets are in
    assert got.agg(F.max("node")).first()[0] < 7 * paths.PART_NODES and got.where("source = 0").agg(F.max("node")).first()[0] < paths.PART_NODES and got.where("source = 100 and node = 98").first()["distance"] == 2
    limits = spark.createDataFrame([(0, 2.0), (0, 4.0), (50, 1.0)], "source long, cutoff double")
    assert {(r["source"], r["count"]) for r in paths.relaxed(limits, edges).groupBy("source").count().collect()} == {(0, 5), (50, 3)}


def test_cluster_graph_and_medians_by_relaxation(spark, monkeypatch):
    edges = spark.createDataFrame(lattice(6), EDGES)
    nodes = spark.createDataFrame([(k, k % 6 * 50.0, k // 6 * 50.0) for k in range(38)], "node long, x double, y double")
    rng = random.Random(5)
    points = spark.createDataFrame([(str(k), t, k % 2, rng.randrange(36)) for t in ("A", "B") for k in range(30)], "point_id string, type string, cluster long, node long")
    dag = spark.createDataFrame([("A", "B", 0.5)], "source_type string, target_type string, technical_coefficient double")
    overlap = spark.createDataFrame([("A", a, "B", b) for a in (0, 1) for b in (0, 1)], "source_type string, source_cluster long, target_type string, target_cluster long")

    def both():
        centers = median.cluster_medians(points, nodes, edges)
        x_nodes, x_edges, apart = xgraph.cluster_graph(centers, dag, overlap, edges)
        return [sorted(map(str, df.select(*sorted(df.columns)).collect())) for df in (centers, x_nodes, x_edges, apart, median.median_distances(points, centers, edges))]

    want = both()
    monkeypatch.setattr(paths, "KERNEL_ARCS", 0)
    assert both() == want and len(want[2]) == 4


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """5,000 arcs: rounds grow with parts; owners are those of the nearer end."""
    written = []
    keep = paths.materialize
    monkeypatch.setattr(paths, "materialize", lambda df, tag, *a: (written.append(tag), keep(df, tag, *a))[1])
    edges = spark.createDataFrame([(k, k, k + 1, 1.0) for k in range(5000)], EDGES)
    ends = spark.createDataFrame([("A", 1, 0), ("A", 0, 5000), ("B", 7, 2500), ("B", 8, 2500)], "type string, cluster long, node long")
    got = paths.nearest_sources(ends, edges).collect()
    assert len(got) == 2 * 5001 and len(written) < 100
    for r in got:
        want = (min(r["node"], 5000 - r["node"]), 1 if r["node"] < 2500 else 0) if r["type"] == "A" else (abs(r["node"] - 2500), 7)
        assert (r["distance"], r["cluster"]) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_sources_over_many_parts(spark, seed, monkeypatch):
    """With small parts, whose arcs mostly cross, owners are those of plain searches from every source."""
    monkeypatch.setattr(paths, "PART_NODES", 7)
    rows = lattice(6) if seed == 1 else tangle(40, seed)
    rng, nodes = random.Random(seed), sorted({x for r in rows for x in r[1:3]})
    sources = [(t, c, rng.choice(nodes)) for t in ("A", "B") for c in range(4) for _ in range(2)]
    edges = spark.createDataFrame(rows, EDGES)
    graph = paths.Graph(*(__import__("numpy").array([r[k] for r in rows]) for k in (1, 2, 3)))
    want = {}
    for t, c, n in sources:
        for node, d in graph.distances(n)[0].items():
            want.setdefault((t, node), []).append((d, c))
    got = {(r["type"], r["node"]): (r["distance"], r["cluster"]) for r in paths.nearest_sources(spark.createDataFrame(sources, "type string, cluster long, node long"), edges).collect()}
    assert got == {k: (min(v)[0], min(c for d, c in v if d <= min(v)[0] + 1e-9)) for k, v in want.items()}


def test_pairs_are_counted_before_they_are_written(spark, monkeypatch):
    """Bounds hold from above; over the cap no pair is written, and the number is exact."""
    rng = random.Random(6)
    ways = [(k, 0, [{"x": 0.0, "y": 40.0 * k}, {"x": 200.0, "y": 40.0 * k}]) for k in range(3)] + [(9, 0, [{"x": 0.0, "y": 0.0}, {"x": 0.0, "y": 40.0}, {"x": 0.0, "y": 80.0}])]
    v, a = roads.build_network(spark.createDataFrame(ways, "line_id long, part int, coords array<struct<x:double,y:double>>"))
    rows = [(str(k), "few" if k % 4 == 0 else "many", rng.choice([0.0, rng.uniform(0, 60)]), 40.0 * rng.randrange(3)) for k in range(80)]
    places, _ = roads.positions(roads.materialize(roads.snap(spark.createDataFrame(rows, "point_id string, type string, x double, y double"), v, a), "s"))
    exact = {r["type"]: r["count"] for r in paths.neighbor_pairs(places, a, 70.0).groupBy("type").count().collect()}
    at = paths.attachments(places).where("along <= 70")
    bound = paths._most_pairs(at, paths.distances(at.select(F.col("node").alias("source")), a, 70.0), places, 70.0)
    assert set(bound) == set(exact) and all(exact[t] <= bound[t] <= 8 * exact[t] + 400 for t in exact)
    written = {}
    keep = paths.materialize
    monkeypatch.setattr(paths, "materialize", lambda df, tag, *r: written.setdefault(tag, keep(df, tag, *r)))
    pairs, over = paths.pairs_within(places, a, 70.0, exact["many"] - 1)
    assert over == {"many": exact["many"]} and pairs.count() == exact["few"]
    assert written["neighbours"].where("type = 'many'").count() == 0
    with pytest.raises(paths.TooManyPairs, match=str(exact["many"])):
        paths.neighbor_pairs(places, a, 70.0, exact["many"] - 1)
    assert paths.pairs_within(places, a, 70.0, exact["many"])[1] == {}


def test_a_given_table_of_distances_is_checked(spark):
    pairs = lambda *rows: spark.createDataFrame(rows, "type string, i long, j long, d double")
    density.check_pairs(pairs(("a", 0, 1, 1.0), ("b", 0, 1, 0.0)))
    for wrong in ([("a", 0, 0, 1.0)], [("a", 0, 1, -1.0)], [("a", 0, 1, float("nan"))], [("a", 0, 1, float("inf"))], [("a", 0, 1, None)], [("a", 0, 1, 1.0), ("a", 1, 0, 1.0)]):
        with pytest.raises(ValueError):
            density.check_pairs(pairs(*wrong))


def test_clusters_that_no_road_joins_get_centroids(spark):
    edges = spark.createDataFrame([(0, 0, 1, 10.0), (1, 2, 3, 10.0)], EDGES)
    nodes = spark.createDataFrame([(0, 0.0, 0.0, 0), (1, 10.0, 0.0, 0), (2, 0.0, 8.0, 2), (3, 10.0, 8.0, 2)], "node long, x double, y double, component long")
    points = spark.createDataFrame([("a", "A", 0, 0, 0.0, 0.0), ("b", "A", 0, 0, 0.0, 0.0), ("c", "A", 0, 1, 10.0, 0.0), ("d", "B", 0, 0, 0.0, 0.0), ("e", "B", 0, 3, 10.0, 8.0), ("f", "B", 0, 3, 10.0, 8.0)], "point_id string, type string, cluster long, node long, x double, y double")
    with pytest.raises(ValueError, match="as a whole"):
        median.cluster_medians(points, nodes, edges)
    got = {r["type"]: r for r in median.medians_or_centroids(points, nodes, edges).collect()}
    assert got["A"]["center_network_node"] == 0 and got["A"]["center_method"] == "network_1_median"
    assert got["B"]["center_network_node"] == 3 and got["B"]["objective"] is None and "fallback" in got["B"]["center_method"]


def test_saved_networks_are_checked(spark):
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "node long")
    edges = lambda *rows: spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], EDGES)
    roads.check_augmented(nodes, edges((0, 1, 1.0), (1, 2, 2.0)))
    for wrong in ([(0, 1, 0.0)], [(0, 3, 1.0)], [(0, 1, 1.0), (1, 0, 2.0)], [(-1, 1, 1.0)]):
        with pytest.raises(ValueError):
            roads.check_augmented(nodes, edges(*wrong))
    with pytest.raises(ValueError, match="numbers"):
        roads.check_augmented(nodes.where("node <> 1"), edges((0, 2, 1.0)))


def test_x_is_restored_from_its_files(spark, tmp_path):
    """Both forms of the columns give the same graph, and types keep their zeros."""
    (tmp_path / "n.csv").write_text("node_id,type,cluster,cluster_no\ntype=01::cluster=0,01,0,1\ntype=02::cluster=1,02,1,2\n")
    (tmp_path / "e.csv").write_text("source_type,source_cluster,target_type,target_cluster,technical_coefficient,road_distance,edge_weight\n01,0,02,1,0.5,10,5\n")
    (tmp_path / "old.csv").write_text("node_from,node_to,dag_weight,road_distance,weight\ntype=01::cluster=0,type=02::cluster=1,0.5,10,5\n")
    (tmp_path / "d.csv").write_text("source_type,source_cluster,target_type,target_cluster,reason\n01,0,02,3,disconnected_centers\n")
    (tmp_path / "oldd.csv").write_text("type1,cluster1,type2,cluster2,status\n01,0,02,3,disconnected_centers\n")
    at = lambda name: str(tmp_path / name)
    for e, d in (("e.csv", "d.csv"), ("old.csv", "oldd.csv")):
        n, x, apart = outputs.restore_x(spark, at("n.csv"), at(e), at(d))
        assert sorted(map(tuple, n.collect())) == [("type=01::cluster=0", "01", 0), ("type=02::cluster=1", "02", 1)]
        assert [tuple(r) for r in x.collect()] == [("type=01::cluster=0", "type=02::cluster=1", 0.5, 10.0, 5.0)]
        assert [tuple(r) for r in apart.collect()] == [("01", "0", "02", "3", "disconnected_centers")]
        values = {r["node_id"]: r["centrality"] for r in xgraph.centrality(n, x).collect()}
        assert values == pytest.approx({"type=01::cluster=0": 0.5**0.5, "type=02::cluster=1": 0.5**0.5})
