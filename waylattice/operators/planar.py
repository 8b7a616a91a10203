"""Territories in the plane: exact Voronoi cells of clusters' centers, cut along the boundary. Where a surface over roads is not to be had."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from ..functions.geometry import area, is_box, multipolygon_wkb
from ..functions.overlay import cut, half_plane
from .storage import materialize, require

#: Sites of a type in a cell of the finest grid, and halvings of the box at most.
CROWD, DEEPEST = 8, 24
_CELL = "type string, cluster long, x double, y double, ring array<struct<x:double,y:double>>, far double"


def sites_of(points: DataFrame, centers: DataFrame) -> DataFrame:
    """type, cluster, x, y, seed_method: the center of each cluster of points (type, cluster, x, y). Where centers of a type coincide, each of their
    clusters has the mean of its own points instead; ValueError if sites still coincide, or a cluster lacks its center."""
    raw = points.where("cluster >= 0").groupBy("type", F.col("cluster").cast("long").alias("cluster")).agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    known = centers.select("type", F.col("cluster").cast("long").alias("cluster"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    require(known.groupBy("type", "cluster").count().where("count > 1"), "repeated centers")
    require(raw.join(known, ["type", "cluster"], "left_anti").select("type", "cluster"), "clusters without a center")
    require(known.where("x is null or y is null or isnan(x) or isnan(y) or abs(x) = double('Infinity') or abs(y) = double('Infinity')").select("type", "cluster"), "centers without finite coordinates")
    known = raw.join(known, ["type", "cluster"])
    shared = known.groupBy("type", "x", "y").agg(F.count("*").alias("n"))
    known = known.join(shared, ["type", "x", "y"])
    pick = lambda a, b: F.when(F.col("n") > 1, F.col(a)).otherwise(F.col(b))
    method = F.when(F.col("n") > 1, "raw_cluster_centroid_duplicate_center").otherwise("cluster_center").alias("seed_method")
    found = materialize(known.select("type", "cluster", pick("mean_x", "x").alias("x"), pick("mean_y", "y").alias("y"), method), "sites")
    require(found.groupBy("type", "x", "y").count().where("count > 1"), "sites coincide, also at the means of their points")
    return found


def _clipped(box: tuple[float, float, float, float]):
    """Rows (a site and one neighbour each, by site and distance) to the site's cell: the box without what is nearer to a neighbour. Only one
    cell is held, however many neighbours follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        site, ring, far, done = None, [], 0.0, []

        def begin(x: float, y: float) -> list:
            return [(px - x, py - y) for px, py in ((box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3]))]

        def out(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["type", "cluster", "x", "y", "ring", "far"])

        for b in batches:
            for t, c, x, y, dx, dy in zip(*(b.column(k).to_pylist() for k in ("type", "cluster", "x", "y", "dx", "dy")), strict=True):
                if (t, c) != site[:2] if site else True:
                    if site:
                        done.append((*site, [{"x": px + site[2], "y": py + site[3]} for px, py in ring], far))
                    site, ring = (t, c, x, y), begin(x, y)
                    far = max(math.hypot(*p) for p in ring)
                if dx is None or math.hypot(dx, dy) > 2 * far:
                    continue  # no corner is nearer to it than to the site
                ring = half_plane(ring, dx, dy, (dx * dx + dy * dy) / 2)
                far = max((math.hypot(*p) for p in ring), default=0.0)
            if len(done) >= 256:
                yield out(done)
                done = []
        if site:
            done.append((*site, [{"x": px + site[2], "y": py + site[3]} for px, py in ring], far))
        if done:
            yield out(done)

    return run


def voronoi_cells(sites: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """type, cluster, x, y, ring, far: the part of a box that is nearest to each site of a type (type, cluster, x, y; no two in one place). ring has the corners
    of the convex cell, far is the largest distance of one from the site; a cell may be empty if its site is outside the box.

    A site looks for neighbours in the cells around its own on the finest of some nested grids. If no corner of what is left is so far away that an unseen
    site could reach it, the cell is proven; else the site looks again on a grid twice as coarse. The coarsest cell holds all sites, so every cell is exact."""
    reach = sites.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    x0, y0 = min(box[0], reach[0] if reach[0] is not None else box[0]), min(box[1], reach[1] if reach[1] is not None else box[1])
    wide = max(max(box[2], reach[2] or box[2]) - x0, max(box[3], reach[3] or box[3]) - y0, 1e-300) * (1 + 1e-9)
    size_of = lambda k: wide * 2.0**-k
    of = lambda c, o, k: F.floor((F.col(c) - o) / size_of(k)).cast("long")
    crowds = sites.select("type", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), of("x", x0, k).alias("cx"), of("y", y0, k).alias("cy")) for k in range(DEEPEST + 1)])).alias("c"))
    crowded = crowds.groupBy("type", "c").count().where(F.col("count") > CROWD).agg(F.max("c.k")).first()[0]
    level = 0 if crowded is None else min(DEEPEST, crowded + 1)
    todo, found = sites.select("type", "cluster", "x", "y"), None
    while True:
        size = size_of(level)
        place = lambda df, k=level: df.withColumn("cx", of("x", x0, k)).withColumn("cy", of("y", y0, k))
        around = F.explode(F.expr("flatten(transform(sequence(-1L, 1L), i -> transform(sequence(-1L, 1L), j -> struct(cx + i as cx, cy + j as cy))))"))
        looking = place(todo).withColumn("near", around).select("type", "cluster", "x", "y", F.col("near.cx").alias("cx"), F.col("near.cy").alias("cy"))
        others = place(sites).select("type", "cx", "cy", F.col("cluster").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        met = looking.join(others, ["type", "cx", "cy"]).where("cluster <> other").select("type", "cluster", "x", "y", (F.col("ox") - F.col("x")).alias("dx"), (F.col("oy") - F.col("y")).alias("dy"))
        alone = todo.select("type", "cluster", "x", "y", F.lit(None).cast("double").alias("dx"), F.lit(None).cast("double").alias("dy"))
        dealt = met.unionByName(alone).repartition("type", "cluster").sortWithinPartitions("type", "cluster", F.expr("dx * dx + dy * dy").asc_nulls_first())
        cells = place(materialize(dealt.mapInArrow(_clipped(box), _CELL), "voronoi-cells"))
        # all sites nearer than this have been seen
        seen = F.least(*[e for c, k, o in (("x", "cx", x0), ("y", "cy", y0)) for e in (F.col(c) - o - (F.col(k) - 1) * size, o + (F.col(k) + 2) * size - F.col(c))])
        sure = (2 * F.col("far") <= seen) | F.lit(level == 0)
        done = cells.where(sure).drop("cx", "cy")
        found = done if found is None else found.unionByName(done)
        todo = cells.where(~sure).select("type", "cluster", "x", "y")
        if level == 0 or todo.isEmpty():
            return found
        level -= 1


def planar_territories(points: DataFrame, centers: DataFrame, boundary: list) -> DataFrame:
    """type, cluster, geometry, area, seed_method: the boundary (polygons, a geometry that every task gets) dealt to the nearest center of each type.

    ValueError for sites as sites_of says, for a cluster that gets no area, or if areas don't add up to the boundary's. Empty points give an empty result."""
    xs, ys = [x for p in boundary for x, _ in p[0]], [y for p in boundary for _, y in p[0]]
    whole, irregular = area(boundary), not is_box(boundary)
    sites = sites_of(points, centers)
    schema = StructType([*sites.schema.fields[:2], StructField("geometry", BinaryType()), StructField("area", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(cut(own, boundary) if irregular else own) if len(ring) > 2 and (own := [[[*ring, ring[0]]]]) else [] for ring in ([(p["x"], p["y"]) for p in r] for r in b.column("ring").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("type"), b.column("cluster"), pa.array([multipolygon_wkb(f) for f in found], pa.binary()), pa.array([area(f) for f in found], pa.float64())], names=schema.names)

    cells = materialize(voronoi_cells(sites, (min(xs), min(ys), max(xs), max(ys))).mapInArrow(run, schema), "planar-territories")
    require(cells.where(F.col("area") <= max(1e-8, whole * 1e-9)).select("type", "cluster"), "clusters without an area")
    require(cells.groupBy("type").agg(F.sum("area").alias("area")).where(F.abs(F.col("area") - whole) > max(1e-8, whole * 1e-8)), "areas that do not add up to the boundary's")
    return cells.join(sites.select("type", "cluster", "seed_method"), ["type", "cluster"])
