import math
import random

import pytest
from pyspark.sql import functions as F

from waylattice.functions.geometry import area, clip, line_wkb, multipolygon_wkb, overlap_area, polygon_wkb, polygons_of, read_wkb
from waylattice.functions.overlay import cut, difference, half_plane, intersection, invalid, union
from waylattice.operators import outputs, planar, polygons, surface, xgraph
from waylattice.sources.vectors import boundary_of, united


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def star(rng, x, y, n=12):
    ring = [(x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)) for k, r in enumerate(rng.uniform(1, 5) for _ in range(n))]
    return [*ring, ring[0]][:: rng.choice((1, -1))]


@pytest.mark.parametrize("seed", range(20))
def test_overlap_with_a_box_is_the_clipped_area(seed):
    rng = random.Random(seed)
    far = 10.0 ** rng.randint(0, 6)
    a = [[star(rng, far, far), box(far - 0.2, far - 0.2, far + 0.3, far + 0.25)]]
    x, y = far + rng.uniform(-6, 6), far + rng.uniform(-6, 6)
    b = (x, y, x + rng.uniform(0.1, 8), y + rng.uniform(0.1, 8))
    want = area(clip(a, b))
    assert overlap_area(a, [[box(*b)]]) == pytest.approx(want, abs=1e-5)
    assert overlap_area([[box(*b)]], a) == pytest.approx(want, abs=1e-5)
    assert overlap_area(a, a) == pytest.approx(area(a), abs=1e-6)


@pytest.mark.parametrize("seed", range(5))
def test_overlap_of_stars_is_the_sum_of_thin_boxes(seed):
    rng = random.Random(seed)
    a, b = [[star(rng, 0, 0)]], [[star(rng, 1, 2)]]
    cells = [(x / 4, y / 4, (x + 1) / 4, (y + 1) / 4) for x in range(-24, 28) for y in range(-24, 32)]
    parts = [(clip(a, c), clip(b, c)) for c in cells]
    assert overlap_area(a, b) == pytest.approx(sum(overlap_area(p, q) for p, q in parts), abs=1e-9)
    assert sum(min(area(p), area(q)) for p, q in parts) >= overlap_area(a, b) - 1e-9


def test_why_polygons_are_not_valid():
    assert invalid([[box(0, 0, 1, 1)]]) is None and invalid([[box(0, 0, 9, 9), box(1, 1, 2, 2)[::-1], box(3, 3, 4, 4)]]) is None
    assert "cross" in invalid([[[(0, 0), (2, 2), (2, 0), (0, 1), (0, 0)]]]) and "open" in invalid([[box(0, 0, 1, 1)[:-1]]])
    assert "area" in invalid([[[(0, 0), (1, 0), (2, 0), (0, 0)]]]) and "finite" in invalid([[[(0, 0), (math.inf, 0), (1, 1), (0, 0)]]])
    # rings against each other: a hole over the edge, a hole outside, holes and parts that overlap
    for wrong in ([[box(0, 0, 4, 4), box(3, 1, 5, 2)]], [[box(0, 0, 4, 4), box(5, 5, 6, 6)]], [[box(0, 0, 9, 9), box(1, 1, 4, 4), box(3, 3, 5, 5)]], [[box(0, 0, 4, 4)], [box(3, 3, 6, 6)]]):
        assert "cross" in invalid(wrong)


@pytest.mark.parametrize("seed", range(40))
def test_overlay_areas_add_up(seed):
    rng = random.Random(seed)
    far = 10.0 ** rng.randint(0, 6)
    a = [[star(rng, far, far), box(far - 0.2, far - 0.2, far + 0.3, far + 0.25)]]
    b = [[star(rng, far + rng.uniform(-5, 5), far + rng.uniform(-5, 5))]]
    both = overlap_area(a, b)
    for got, want in ((intersection(a, b), both), (union(a + b), area(a) + area(b) - both), (difference(a, b), area(a) - both), (difference(b, a), area(b) - both)):
        assert area(got) == pytest.approx(want, abs=1e-5)
        assert not got or invalid(got) is None


@pytest.mark.parametrize("seed", range(20))
def test_union_of_touching_boxes_is_their_cells(seed):
    rng = random.Random(seed)
    boxes = [(x, y, x + rng.randint(1, 6), y + rng.randint(1, 6)) for x, y in ((rng.randint(0, 20), rng.randint(0, 20)) for _ in range(rng.randint(1, 40)))]
    cells = {(i, j) for p, q, r, t in boxes for i in range(p, r) for j in range(q, t)}
    got = union([[box(*b)] for b in boxes])
    assert area(got) == len(cells) and invalid(got) is None
    assert sorted((x, y) for p in got for r in p for x, y in r[:-1]) == sorted((x, y) for p in surface_outline(cells) for r in p for x, y in r[:-1])


def surface_outline(cells):
    from waylattice.functions.geometry import outline

    return outline(cells)


def test_overlay_of_nothing_and_of_itself():
    a = [[box(0, 0, 4, 4), box(1, 1, 2, 2)]]
    assert union([]) == [] and intersection(a, []) == [] and difference([], a) == [] and difference(a, a) == []
    assert area(union(a + a)) == area(intersection(a, a)) == 15 and area(difference(a, [])) == 15
    assert half_plane(box(0, 0, 2, 2)[:-1], 1, 0, 1) == [(0, 0), (1, 0), (1, 2), (0, 2)] and half_plane([], 1, 0, 1) == []


def frame(spark, rows):
    return spark.createDataFrame([(t, c, bytearray(g) if g is not None else None, "x") for t, c, g in rows], "type string, cluster long, geometry binary, area string")


def test_overlaps_of_polygons(spark):
    holed = polygon_wkb([box(0, 0, 30, 30), box(10, 10, 20, 20)])
    rows = [("A", 0, holed), ("A", 1, polygon_wkb([box(30, 0, 60, 30)])), ("B", 0, polygon_wkb([box(12, 12, 18, 18)])), ("B", 1, multipolygon_wkb([[box(29, 29, 31, 31)], [box(100, 100, 101, 101)]])), ("B", 2, polygon_wkb([box(30, 30, 40, 40)])), ("C", 0, polygon_wkb([box(0, 0, 60, 30)]))]
    p = polygons.clean_partitions(frame(spark, rows))
    assert p.where("type = 'A' and cluster = 0").first()["area"] == 800
    dag = spark.createDataFrame([("A", "B"), ("C", "A")], "source_type string, target_type string")
    got = {tuple(r) for r in polygons.polygon_overlaps(p, dag).collect()}
    assert got == {("A", 0, "B", 1), ("A", 1, "B", 1), ("C", 0, "A", 0), ("C", 0, "A", 1)}
    # a rotated square meets a corner of another only by its edge
    tilted = [("A", 0, polygon_wkb([[(0, 1), (1, 0), (2, 1), (1, 2), (0, 1)]])), ("B", 0, polygon_wkb([[(0, 0), (1, 0), (0, 1), (0, 0)]])), ("B", 1, polygon_wkb([box(0, 0, 0.6, 0.6)]))]
    assert [tuple(r) for r in polygons.polygon_overlaps(polygons.clean_partitions(frame(spark, tilted)), dag).collect()] == [("A", 0, "B", 1)]
    assert polygons.polygon_overlaps(polygons.clean_partitions(frame(spark, [])), dag).count() == 0


def test_x_from_polygons(spark):
    p = polygons.clean_partitions(frame(spark, [("A", 0, polygon_wkb([box(0, -2, 20, 2)])), ("B", 0, polygon_wkb([box(0, -2, 20, 2)]))]))
    dag = spark.createDataFrame([("A", "B", 3.0)], "source_type string, target_type string, technical_coefficient double")
    centers = spark.createDataFrame([("A", 0, 0, 2.0, 0.0), ("B", 0, 1, 18.0, 0.0)], "type string, cluster long, center_network_node long, x double, y double")
    edges = spark.createDataFrame([(0, 0, 1, 16.0)], "aug_edge_id long, u long, v long, length double")
    _, e, apart = xgraph.cluster_graph(centers, dag, polygons.polygon_overlaps(p, dag), edges)
    assert [(r["road_distance"], r["edge_weight"]) for r in e.collect()] == [(16.0, 48.0)] and apart.count() == 0


@pytest.mark.parametrize(
    "row",
    [("A", -1, polygon_wkb([box(0, 0, 1, 1)])), ("A", None, polygon_wkb([box(0, 0, 1, 1)])), ("A", 0, None), ("A", 0, line_wkb([(0, 0), (1, 1)])), ("A", 0, multipolygon_wkb([])), ("A", 0, polygon_wkb([[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]])), ("A", 5, polygon_wkb([box(0, 0, 1, 1)]))],
)
def test_wrong_partitions(spark, row):
    with pytest.raises(ValueError):
        polygons.clean_partitions(frame(spark, [("A", 5, polygon_wkb([box(0, 0, 1, 1)])), row]))


def test_partitions_in_degrees(spark):
    p = polygons.clean_partitions(frame(spark, [("1", 0, polygon_wkb([box(121, 14, 121.01, 14.01)]))]), 4326, 32651)
    assert p.first()["area"] == pytest.approx(1.195e6, rel=0.01) and p.columns == ["type", "cluster", "geometry", "area", "x0", "y0", "x1", "y1"]
    with pytest.raises(ValueError, match="geometry"):
        polygons.clean_partitions(p.select("type", F.col("cluster")))


def test_a_wide_polygon_is_not_cut_finely(spark):
    small = [("A", k, polygon_wkb([box(x, y, x + 1, y + 1)])) for k, (x, y) in enumerate((x * 3, y * 3) for x in range(30) for y in range(30))]
    wide = [("B", 0, polygon_wkb([box(-500, -500, 2000, 2000)]))]
    p = polygons.clean_partitions(frame(spark, small + wide))
    cut_ = polygons.pieces(p)
    assert cut_.where("type = 'B'").count() <= (2 ** (polygons.FINE + 1) + 1) ** 2
    dag = spark.createDataFrame([("A", "B"), ("B", "A")], "source_type string, target_type string")
    got = polygons.polygon_overlaps(p, dag)
    assert got.where("source_type = 'A'").count() == got.where("source_type = 'B'").count() == 900


def plain_union_area(rows):
    return area(union([p for g in rows for p in polygons_of(read_wkb(g))]))


@pytest.mark.parametrize("meet", [8, 256])
def test_union_of_a_type(spark, meet, monkeypatch):
    monkeypatch.setattr(polygons, "MEET", meet)
    rng = random.Random(4)
    rows = [(t, k, polygon_wkb([star(rng, rng.uniform(-30, 30), rng.uniform(-30, 30))])) for t in "AB" for k in range(40)]
    rows += [("A", 60, polygon_wkb([box(-20, -20, 200, 90)])), ("C", 0, polygon_wkb([box(5, 5, 9, 9), box(6, 6, 7, 7)])), ("C", 1, polygon_wkb([box(6, 6, 7, 7)])), ("C", 2, polygon_wkb([box(5, 5, 9, 9), box(6, 6, 7, 7)]))]
    p = polygons.clean_partitions(frame(spark, rows))
    want = {t: plain_union_area([g for u, _, g in rows if u == t]) for t in "ABC"}
    got = polygons.disjoint_parts(p).groupBy("type").agg(F.sum("area").alias("a"))
    assert {r["type"]: r["a"] for r in got.collect()} == pytest.approx(want, abs=1e-5)
    whole = {r["type"]: r for r in polygons.dissolve(p).collect()}
    for t, r in whole.items():
        found = polygons_of(read_wkb(bytes(r["geometry"])))
        assert area(found) == pytest.approx(want[t], abs=1e-5) and r["area"] == pytest.approx(want[t], abs=1e-5) and invalid(found) is None
    assert len(whole) == 3 and polygons.dissolve(p.limit(0)).count() == 0
    assert len(polygons_of(read_wkb(bytes(whole["C"]["geometry"])))[0]) == 1


def test_boundary_of_overlapping_features(spark):
    rows = [(bytearray(polygon_wkb([box(0, 0, 4, 4)])),), (bytearray(multipolygon_wkb([[box(2, 2, 6, 6)], [box(9, 9, 10, 10)]])),), (None,)]
    df = spark.createDataFrame(rows, "geometry binary")
    got = boundary_of(df)
    assert area(got) == 16 + 16 - 4 + 1 and len(got) == 2 and invalid(got) is None
    with pytest.raises(ValueError, match="not valid"):
        united([[[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]]])
    with pytest.raises(ValueError, match="no polygon"):
        boundary_of(df.where("geometry is null"))


CONCAVE = [[[(0.0, 0.0), (20.0, 0.0), (20.0, 13.0), (11.0, 4.5), (0.0, 11.0), (0.0, 0.0)], [(3.0, 2.0), (3.0, 4.0), (6.0, 3.0), (3.0, 2.0)]]]


def test_outlines_sum_to_a_concave_boundary_with_a_hole(spark):
    cells = surface.grid(spark, CONCAVE, 1.0, 1000).select(F.when(F.col("ix") < 9, "A").otherwise("B").alias("type"), F.col("iy").cast("long").alias("cluster"), F.lit(0).alias("level"), "ix", "iy", "area")
    cut_ = outputs.partitions_of(cells, (0.0, 0.0), 1.0, 2, (0.0, 0.0, 20.0, 13.0), CONCAVE).collect()
    sizes = {(r["type"], r["cluster"]): area(polygons_of(read_wkb(bytes(r["geometry"])))) for r in cut_}
    assert sum(sizes.values()) == pytest.approx(area(CONCAVE), rel=1e-9)
    for r in cells.groupBy("type", "cluster").agg(F.sum("area").alias("a")).collect():
        assert sizes[r["type"], r["cluster"]] == pytest.approx(r["a"], rel=1e-7)
    assert all(invalid(polygons_of(read_wkb(bytes(r["geometry"])))) is None for r in cut_)


def plain_cells(sites, boundary):
    """Each site against every other."""
    out = {}
    for k, (x, y) in sites.items():
        ring = [(-100.0, -100.0), (100.0, -100.0), (100.0, 100.0), (-100.0, 100.0)]
        for o, (a, b) in sites.items():
            if o != k:
                ring = half_plane(ring, a - x, b - y, (a * a + b * b - x * x - y * y) / 2)
        out[k] = area(cut([[[*ring, ring[0]]]], boundary))
    return out


@pytest.mark.parametrize("n", [1, 2, 60])
def test_planar_territories_equal_all_half_planes(spark, n):
    rng = random.Random(n)
    at = lambda k: (rng.uniform(0.5, 19), rng.uniform(0.2, 1.8)) if k % 3 else (10 + rng.uniform(0, 0.3), 1 + rng.uniform(0, 0.3))
    sites = {t: {k: at(k) for k in range(n)} for t in "AB"}
    rows = [(t, k, x, y) for t, own in sites.items() for k, (x, y) in own.items()]
    centers = spark.createDataFrame(rows, "type string, cluster long, x double, y double")
    got = planar.planar_territories(centers, centers, CONCAVE)
    assert {r[0] for r in got.select("seed_method").distinct().collect()} == {"cluster_center"}
    for t, own in sites.items():
        want = plain_cells(own, CONCAVE)
        assert {r["cluster"]: r["area"] for r in got.where(F.col("type") == t).collect()} == pytest.approx(want, abs=1e-5)


def test_coincident_centers_take_the_means_of_their_points(spark):
    points = spark.createDataFrame([("A", 0, 1.0, 0.0), ("A", 0, 2.0, 0.0), ("A", 1, 8.0, 0.0), ("A", 1, 9.0, 0.0), ("A", -1, 5.0, 5.0)], "type string, cluster long, x double, y double")
    centers = spark.createDataFrame([("A", 0, 5.0, 0.0), ("A", 1, 5.0, 0.0)], "type string, cluster long, x double, y double")
    got = {r["cluster"]: r for r in planar.planar_territories(points, centers, [[box(0, -5, 10, 5)]]).collect()}
    assert [got[k]["area"] for k in (0, 1)] == pytest.approx([50, 50]) and got[0]["seed_method"] == "raw_cluster_centroid_duplicate_center"
    same = points.where("x in (1, 2)").unionByName(points.where("x in (1, 2)").withColumn("cluster", F.lit(1).cast("long")))
    with pytest.raises(ValueError, match="coincide"):
        planar.planar_territories(same, centers, [[box(0, -5, 10, 5)]])
    with pytest.raises(ValueError, match="without a center"):
        planar.planar_territories(points, centers.where("cluster = 0"), [[box(0, -5, 10, 5)]])
    with pytest.raises(ValueError, match="without an area"):
        planar.planar_territories(points, spark.createDataFrame([("A", 0, 5.0, 0.0), ("A", 1, 500.0, 0.0)], centers.schema), [[box(0, -5, 10, 5)]])
    assert planar.planar_territories(points.limit(0), centers, [[box(0, -5, 10, 5)]]).count() == 0


def test_types_too_dense_for_the_grid_get_planar_territories(spark):
    n, e = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 20.0, 0.0)], "node long, x double, y double"), spark.createDataFrame([(0, 0, 1, 1.0), (1, 1, 2, 19.0)], "aug_edge_id long, u long, v long, length double")
    points = spark.createDataFrame([("A", 0, 0, 0.0, 0.0), ("A", 1, 1, 1.0, 0.0), ("A", 2, 2, 20.0, 0.0), ("B", 0, 0, 0.0, 0.0), ("B", 1, 2, 20.0, 0.0)], "type string, cluster long, node long, x double, y double")
    config = surface.SurfaceConfig(10.0, max_refinements=0)
    with pytest.raises(ValueError, match="too coarse"):
        surface.territories(points, n, e, [[box(0, -5, 20, 5)]], config)
    cells, planar_ = surface.territories_or_planar(points, points, n, e, [[box(0, -5, 20, 5)]], config)
    assert {r[0] for r in cells.select("type").distinct().collect()} == {"B"} and cells.agg(F.sum("area")).first()[0] == 200
    assert {(r["type"], r["cluster"], round(r["area"], 6)) for r in planar_.collect()} == {("A", 0, 5.0), ("A", 1, 100.0), ("A", 2, 95.0)}


@pytest.mark.parametrize("seed", range(12))
def test_lattice_and_split_edges_give_the_same(seed, monkeypatch):
    from waylattice.functions import overlay

    rng = random.Random(seed)
    some = lambda n: [[box(x, y, x + rng.randint(1, 6), y + rng.randint(1, 6))[:: rng.choice((1, -1))]] for x, y in ((rng.randint(-9, 14) / 4, rng.randint(-9, 14) / 4) for _ in range(n))]
    a, b = union(some(30)), some(12)
    got, called = [], []
    split = overlay._split
    monkeypatch.setattr(overlay, "_split", lambda *e: called.append(1) or split(*e))
    for most in (1 << 24, 0):
        monkeypatch.setattr(overlay, "LATTICE", most)
        found = [f(a, b) for f in (intersection, difference, lambda p, q: union(p + q))]
        got.append([(area(g), sorted((x, y) for p in g for r in p for x, y in r[:-1]), sorted(map(len, g))) for g in found] + [invalid(a + b), *map(invalid, filter(None, found))])
        assert bool(called) == (not most)  # edges along the axes are summed, not split one by one
    assert got[0] == got[1]


def test_boxes_stay_whole_and_meet_once(spark):
    rng = random.Random(7)
    rows = [(rng.choice("AB"), k, (x, y, x + rng.randint(1, 17), y + rng.randint(1, 13))) for k, (x, y) in enumerate((rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(80))]
    tilted = [("B", 900, [(0, 10), (10, 0), (20, 10), (10, 20), (0, 10)]), ("A", 901, [(-20, 0), (0, -20), (20, 0), (0, 20), (-20, 0)])]
    given = frame(spark, [(t, c, polygon_wkb([box(*b)])) for t, c, b in rows] + [(t, c, polygon_wkb([r])) for t, c, r in tilted]).coalesce(1)
    p = polygons.clean_partitions(given)
    assert len(p.inputFiles()) > 8  # one file's rows are checked by many tasks
    assert polygons.pieces(p, polygons.COARSE).count() <= 4 * len(rows + tilted)
    shapes = [(t, c, [[box(*b)]]) for t, c, b in rows] + [(t, c, [[r]]) for t, c, r in tilted]
    want = sorted(("A", c, "B", d) for t, c, a in shapes if t == "A" for u, d, b in shapes if u == "B" and overlap_area(a, b) > 1e-6)
    got = polygons.polygon_overlaps(p, spark.createDataFrame([("A", "B")], "source_type string, target_type string"))
    assert sorted(map(tuple, got.collect())) == want
