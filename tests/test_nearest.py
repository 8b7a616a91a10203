"""Nearest arcs over arcs of very different lengths."""

import random

import pytest
from pyspark.sql import functions as F

from waylattice.operators import roads

ENDS = "arc_id long, u long, v long, length double, ax double, ay double, bx double, by double"


def arcs(rng, n, long):
    rows = []
    for k in range(n):
        x, y = rng.uniform(0, 3000), rng.uniform(0, 3000)
        rows.append((k, 2 * k, 2 * k + 1, 50.0, x, y, x + rng.choice([-30.0, 30.0]), y + 40.0))
    return rows + [(n + k, -1, -2, 100_000.0, *e) for k, e in enumerate(long)]


def plain(p, rows):
    def far(r):
        _, _, _, _, ax, ay, bx, by = r
        t = max(0.0, min(1.0, ((p[1] - ax) * (bx - ax) + (p[2] - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return ((p[1] - ax - t * (bx - ax)) ** 2 + (p[2] - ay - t * (by - ay)) ** 2) ** 0.5

    return min(map(far, rows))


@pytest.mark.parametrize("long", [[], [(-40_000.0, 1500.0, 60_000.0, 1511.0), (-5e5, -5e5, 5e5, 4.9e5)]])
def test_nearest_arcs_are_those_of_all(spark, long):
    rng = random.Random(8)
    rows = arcs(rng, 300, long)
    points = [(str(k), rng.uniform(-200, 3200), rng.uniform(-200, 3200)) for k in range(120)] + [("far", 90_000.0, -70_000.0), ("negative", -1500.0, -1500.0)]
    got = {}
    for r in roads.near_arcs(spark.createDataFrame(points, "id string, px double, py double"), spark.createDataFrame(rows, ENDS)).collect():
        got.setdefault(r["id"], []).append(r["d"])
    assert set(got) == {p[0] for p in points}
    for p in points:
        assert max(got[p[0]]) == pytest.approx(plain(p, rows), abs=1e-6) and len(set(got[p[0]])) == 1


def test_a_long_arc_does_not_multiply_pairs(spark, monkeypatch):
    """One arc of 100 km among many of 50 m: at most twice the pairs that are compared without it."""
    counted = []
    keep = roads._segment_distance
    monkeypatch.setattr(roads, "_segment_distance", lambda pairs: (counted.append(pairs.count()), keep(pairs))[1])
    rng = random.Random(9)
    points = spark.createDataFrame([(str(k), rng.uniform(0, 3000), rng.uniform(0, 3000)) for k in range(300)], "id string, px double, py double")
    sums = []
    for long in ([], [(-40_000.0, -40_000.0, 40_000.0, 39_000.0)]):
        counted.clear()
        roads.near_arcs(points, spark.createDataFrame(arcs(random.Random(1), 4000, long), ENDS)).count()
        sums.append(sum(counted))
    assert sums[1] <= 2 * sums[0]
    assert sums[0] < 60 * 300


def test_ties_keep_every_arc(spark):
    ends = spark.createDataFrame([(0, 0, 1, 10.0, 0.0, 0.0, 10.0, 0.0), (1, 2, 3, 10.0, 0.0, 4.0, 10.0, 4.0), (2, 4, 5, 10.0, 0.0, 9.0, 10.0, 9.0)], ENDS)
    got = roads.near_arcs(spark.createDataFrame([("p", 5.0, 2.0)], "id string, px double, py double"), ends).select("arc_id", F.round("d", 9).alias("d")).collect()
    assert sorted(map(tuple, got)) == [(0, 2.0), (1, 2.0)]


def test_points_at_one_place_are_looked_up_once(spark, monkeypatch):
    from waylattice.operators import roads

    lines = spark.createDataFrame([(0, 0, [(0.0, 0.0), (10.0, 0.0)]), (1, 0, [(0.0, 5.0), (10.0, 5.0)])], "line_id long, part int, coords array<struct<x:double,y:double>>")
    v, a = roads.build_network(lines)
    looked, near = [], roads.near_arcs
    monkeypatch.setattr(roads, "near_arcs", lambda points, *rest: looked.append(points.count()) or near(points, *rest))
    p = spark.createDataFrame([(str(k), "01", float(k % 2) * 3, 1.0 + k % 2 * 3) for k in range(40)], "point_id string, type string, x double, y double")
    for few in (200_000, 0):
        monkeypatch.setattr(roads, "SNAPPED_PLACES", few)
        got = roads.snap(p, v, a)
        assert sorted((int(r["point_id"]), r["x"], r["snapped_x"], r["snapped_y"], r["snap_distance"]) for r in got.collect()) == [(k, k % 2 * 3.0, k % 2 * 3.0, k % 2 * 5.0, 1.0) for k in range(40)]
    assert looked == [2, 2]
