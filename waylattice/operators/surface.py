"""Territories: the boundary's cells go to the cluster that owns the road nearest to them.

A territory is a set of cells of one grid, whose finer levels nest in the coarser ones: cell ix, iy of level l + 1 lies in
cell ix // s, iy // s of level l, where 1 / s is the refinement factor. So overlap is an equi-join of cell numbers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.geometry import area, clip, interior_point, is_box
from .paths import nearest_sources
from .planar import planar_territories
from .roads import near_arcs
from .storage import materialize, require


@dataclass(frozen=True)
class SurfaceConfig:
    resolution: float = 500.0
    max_cells: int = 1_000_000
    refine_factor: float = 0.5
    max_refinements: int = 5

    def __post_init__(self):
        if not self.resolution > 0 or self.max_cells < 1 or not 0 < self.refine_factor < 1 or self.max_refinements < 0:
            raise ValueError("resolution and max_cells must be positive, the factor between 0 and 1, refinements 0 or more")
        if round(1 / self.refine_factor) != 1 / self.refine_factor:
            raise ValueError("the refinement factor must be one over a whole number, so that grids nest")

    @property
    def split(self) -> int:
        return round(1 / self.refine_factor)


def grid(spark: SparkSession, boundary: list[list[list[tuple[float, float]]]], resolution: float, max_cells: int) -> DataFrame:
    """ix, iy, area, px, py of the cells of a boundary's box that have an area within it; px, py is a point inside that part.

    boundary: polygons as rings, one geometry that every task gets. A rectangle's cells need no clipping."""
    xs = [x for p in boundary for x, _ in p[0]]
    ys = [y for p in boundary for _, y in p[0]]
    x0, y0, x1, y1 = min(xs), min(ys), max(xs), max(ys)
    nx, ny = max(1, int(np.ceil((x1 - x0) / resolution))), max(1, int(np.ceil((y1 - y0) / resolution)))
    if nx * ny > max_cells:
        raise ValueError(f"{nx * ny} cells; at most {max_cells}")
    cells = spark.range(nx * ny).select((F.col("id") % nx).alias("ix"), F.expr(f"id div {nx}").alias("iy"))
    if is_box(boundary):
        left, low = x0 + F.col("ix") * resolution, y0 + F.col("iy") * resolution
        right, top = F.least(left + resolution, F.lit(x1)), F.least(low + resolution, F.lit(y1))
        return cells.select("ix", "iy", ((right - left) * (top - low)).alias("area"), ((left + right) / 2).alias("px"), ((low + top) / 2).alias("py")).where("area > 0")
    schema = StructType([*cells.schema.fields, *[StructField(c, DoubleType()) for c in ("area", "px", "py")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ix, iy in zip(b.column("ix").to_pylist(), b.column("iy").to_pylist(), strict=True):
                box = (x0 + ix * resolution, y0 + iy * resolution, x0 + (ix + 1) * resolution, y0 + (iy + 1) * resolution)
                part = clip(boundary, box)
                if part and (a := area(part)) > 0:
                    rows.append((ix, iy, a, *interior_point(part)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=schema.names)

    return cells.mapInArrow(run, schema)


def owner_on_edge() -> F.Column:
    """The owner of a place on an edge, from the owners cu, cv and distances du, dv of its ends, its length and the offset from u: at
    an end, that end's; else the side of the point where both ways are equally long, and on it the smaller."""
    slack = F.greatest(F.lit(1e-10), F.col("length") * 1e-12)
    split = F.greatest(F.lit(0.0), F.least(F.col("length"), (F.col("dv") + F.col("length") - F.col("du")) / 2))
    o = F.col("offset")
    return (
        F.when(o <= slack, F.col("cu")).when(F.col("length") - o <= slack, F.col("cv")).when(F.col("cu") == F.col("cv"), F.col("cu"))
        .when(o < split - slack, F.col("cu")).when(o > split + slack, F.col("cv")).otherwise(F.least("cu", "cv"))
    )


def cell_owners(cells: DataFrame, owners: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """type, cluster, ix, iy, area: for each type and cell the owner at the nearest place on an edge that both ends of which are reached;
    of several equally near edges, the smallest owner."""
    own = lambda side: owners.select("type", F.col("node").alias(side), F.col("cluster").alias(f"c{side}"), F.col("distance").alias(f"d{side}"))
    a = nodes.select(F.col("node").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nodes.select(F.col("node").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"))
    reached = materialize(edges.select("aug_edge_id", "u", "v", "length").join(own("u"), "u").join(own("v"), ["type", "v"]).join(a, "u").join(b, "v"), "reached-edges")
    types = owners.select("type").distinct()
    looking = cells.withColumn("one_", F.lit(1)).join(F.broadcast(types.withColumn("one_", F.lit(1))), "one_").drop("one_")
    looking = materialize(looking.withColumn("id", F.concat_ws("/", "type", F.col("ix").cast("string"), F.col("iy").cast("string"))), "type-cells")
    near = near_arcs(looking.select("id", "type", "px", "py"), reached, by=("type",)).withColumn("offset", F.col("t") * F.col("length"))
    owner = near.withColumn("owner", owner_on_edge()).groupBy("id").agg(F.min("owner").alias("cluster"))
    return looking.join(owner, "id").select("type", "cluster", "ix", "iy", "area")


def territories(points: DataFrame, nodes: DataFrame, edges: DataFrame, boundary, config: SurfaceConfig, progress=None, failing: list[str] | None = None) -> DataFrame:
    """type, cluster, level, ix, iy, area of all clusters of points (type, cluster, node).

    A type of which some cluster gets no cell is tried again on the next finer grid, up to max_refinements; then it is an
    error, unless a list is given that gets the failing types. Types are solved together; only the failing ones go on."""
    spark = points.sparkSession
    sources = materialize(points.select("type", "cluster", "node").distinct(), "surface-sources")
    owners = materialize(nearest_sources(sources, edges), "owners")
    wanted = sources.select("type", "cluster").distinct()
    todo, found, size = [r[0] for r in wanted.select("type").distinct().collect()], None, config.resolution
    for level in range(config.max_refinements + 1):
        if progress:
            progress(f"surface of {len(todo)} types at {size:g}")
        cells = grid(spark, boundary, size, config.max_cells)
        now = materialize(cell_owners(cells, owners.where(F.col("type").isin(todo)), nodes, edges), "cells")
        missing = wanted.where(F.col("type").isin(todo)).join(now, ["type", "cluster"], "left_anti")
        without = [r[0] for r in missing.select("type").distinct().collect()]
        done = now.where(~F.col("type").isin(without)).select("type", "cluster", F.lit(level).alias("level"), "ix", "iy", "area")
        found = done if found is None else found.unionByName(done)
        todo, size = without, size * config.refine_factor
        if not todo:
            return materialize(found, "territories")
    if failing is not None:
        failing += todo
        return materialize(found, "territories")
    raise ValueError(f"the grid is too coarse for a cluster of types {', '.join(sorted(todo))}")


def territories_or_planar(points: DataFrame, centers: DataFrame, nodes: DataFrame, edges: DataFrame, boundary, config: SurfaceConfig, progress=None) -> tuple[DataFrame, DataFrame]:
    """Territories, and for types of which some cluster gets no cell of the finest grid, planar ones (see planar_territories) by the clusters' centers."""
    failing: list[str] = []
    cells = territories(points, nodes, edges, boundary, config, progress, failing)
    own = points.where(F.col("type").isin(failing))
    return cells, planar_territories(own, centers.where(F.col("type").isin(failing)), boundary)


def overlaps(cells: DataFrame, dag: DataFrame, split: int = 2) -> DataFrame:
    """source_type, source_cluster, target_type, target_cluster of territories of types that the graph joins and that share an area.

    A cell meets cells of its own level and the ones of coarser levels that hold it."""
    top = cells.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
    up = F.explode(F.sequence(F.lit(0), F.col("level"))).alias("at")
    power = F.pow(F.lit(float(split)), F.col("level") - F.col("at")).cast("long")
    keyed = cells.where("area > 0").select("type", "cluster", "level", "ix", "iy", up).withColumn("kx", F.floor(F.col("ix") / power).cast("long")).withColumn("ky", F.floor(F.col("iy") / power).cast("long"))
    keyed = keyed.select("type", "cluster", "at", "kx", "ky", (F.col("at") == F.col("level")).alias("own")).groupBy("type", "cluster", "at", "kx", "ky").agg(F.max("own").alias("own")) if top else keyed.select("type", "cluster", "at", "kx", "ky", F.lit(True).alias("own"))
    a = keyed.select(F.col("type").alias("source_type"), F.col("cluster").alias("source_cluster"), "at", "kx", "ky", F.col("own").alias("own_a"))
    b = keyed.select(F.col("type").alias("target_type"), F.col("cluster").alias("target_cluster"), "at", "kx", "ky", F.col("own").alias("own_b"))
    pairs = dag.select("source_type", "target_type").distinct()
    found = a.join(F.broadcast(pairs), "source_type").join(b, ["target_type", "at", "kx", "ky"]).where("own_a or own_b")
    return found.select("source_type", "source_cluster", "target_type", "target_cluster").distinct()


def check_territories(cells: DataFrame) -> None:
    require(cells.where("not area > 0 or area = double('Infinity')").select("type", "cluster", "ix", "iy"), "cells without an area")
    require(cells.groupBy("type", "cluster").agg(F.count_distinct("level").alias("levels")).where("levels > 1"), "territories on several levels")
