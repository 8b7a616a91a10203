"""Territories that come as polygons, from anyone: checks, which of them overlap, and what they cover together."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from ..functions.geometry import MULTIPOLYGON, POLYGON, area, clip, is_box, multipolygon_wkb, overlap_area, polygons_of, read_wkb, reproject
from ..functions.overlay import difference, invalid, union
from ..functions.sectors import sector_id
from .storage import dealt, materialize, require

#: Pieces of one cell share no area if it is less than this part of the smaller one, and boxes if the area is narrower than this part of the narrower one, or
#: lower: what rounding of coordinates leaves along common edges.
LEAST_SHARE = 1e-9
#: Pieces of a polygon that are written at once.
PIECES = 512
#: To compare it, a polygon is cut in cells of a width that is a power of two, between 2 ** -FINE of its own width and half of that; to unite it, in cells
#: that are wider than itself, so in four pieces at most.
FINE, COARSE = 2, -1
#: Pieces of one cell that are united in one task.
MEET = 256

_CHECKED = StructType([StructField("type", StringType()), StructField("cluster", LongType()), StructField("geometry", BinaryType()), *[StructField(c, DoubleType()) for c in ("area", "x0", "y0", "x1", "y1")], StructField("problem", StringType())])
_PIECE = StructType([StructField("type", StringType()), StructField("cluster", LongType()), StructField("level", LongType()), StructField("kx", LongType()), StructField("ky", LongType()), StructField("piece", BinaryType()), *[StructField(c, DoubleType()) for c in ("area", "x0", "y0", "x1", "y1")]])


def _problem(kind: int, polygons, size: float) -> str | None:
    if kind not in (POLYGON, MULTIPOLYGON) or not polygons:
        return "not one polygonal geometry that is not empty"
    if is_box(polygons) and polygons[0][0][0] == polygons[0][0][-1] and 0 < size < math.inf:
        return None
    return (invalid(polygons) if all(polygons) else "a polygon without rings") or (None if 0 < size < math.inf else "no area")


def clean_partitions(partitions: DataFrame, source: int | None = None, target: int | None = None) -> DataFrame:
    """type, cluster, geometry, area and box (x0, y0, x1, y1) of territories, in another reference system if both codes are given.

    ValueError if a column is missing, a cluster is negative or null, a key repeats, or a geometry is null, empty, not
    polygonal, without an area, or has a ring that is open or rings that cross themselves or each other. An empty table stays empty; other columns go."""
    if missing := sorted({"type", "cluster", "geometry"} - {*partitions.columns}):
        raise ValueError(f"partitions lack the columns {', '.join(missing)}")
    rows = partitions.select(sector_id(F.col("type")).alias("type"), F.col("cluster").cast("long").alias("cluster"), "geometry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, c, g in zip(*(b.column(x).to_pylist() for x in ("type", "cluster", "geometry")), strict=True):
                kind, found = read_wkb(g) if g else (0, None)
                polygons = polygons_of((kind, found)) if kind in (POLYGON, MULTIPOLYGON) else []
                if source and target and source != target:
                    polygons = [[[reproject(x, y, source, target) for x, y in r] for r in p] for p in polygons]
                size = area(polygons)
                xs, ys = [[p[k] for q in polygons for r in q for p in r] or [0.0] for k in (0, 1)]
                out.append((t, c, multipolygon_wkb(polygons), size, min(xs), min(ys), max(xs), max(ys), _problem(kind, polygons, size)))
            yield pa.RecordBatch.from_pylist([dict(zip(_CHECKED.names, r, strict=True)) for r in out], _arrow(_CHECKED))

    found = materialize(dealt(rows).mapInArrow(run, _CHECKED), "partitions-checked")
    require(found.where("type is null").select("cluster"), "rows without a type")
    require(found.where("cluster is null or cluster < 0").select("type", "cluster"), "partitions need a cluster of 0 or more")
    require(found.where("problem is not null").select("type", "cluster", "problem"), "partitions of a wrong form")
    require(found.groupBy("type", "cluster").count().where("count > 1"), "repeated partitions")
    return found.drop("problem")


def _arrow(schema: StructType) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(f.name, kinds[f.dataType.typeName()]) for f in schema.fields])


def pieces(partitions: DataFrame, fine: int = FINE) -> DataFrame:
    """The parts of each polygon in the cells of a grid over the plane: type, cluster, level, kx, ky, piece, area and box (x0, y0, x1, y1). A cell is
    2 ** level wide, and the level goes by the polygon's own width, so that a polygon of any width has (2 ** (fine + 1) + 1) ** 2 pieces at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                polygons, out = polygons_of(read_wkb(r["geometry"])), []
                level = math.floor(math.log2(max(r["x1"] - r["x0"], r["y1"] - r["y0"]))) - fine
                size = 2.0**level
                for kx in range(math.floor(r["x0"] / size), math.floor(r["x1"] / size) + 1):
                    strip = clip(polygons, (kx * size, r["y0"], (kx + 1) * size, r["y1"]))
                    for ky in range(math.floor(r["y0"] / size), math.floor(r["y1"] / size) + 1) if strip else ():
                        piece = clip(strip, (kx * size, ky * size, (kx + 1) * size, (ky + 1) * size))
                        if piece and (a := area(piece)) > 0:
                            xs, ys = [[p[k] for q in piece for p in q[0]] for k in (0, 1)]
                            own = {"x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys)}
                            out.append({"type": r["type"], "cluster": r["cluster"], "level": level, "kx": kx, "ky": ky, "piece": multipolygon_wkb(piece), "area": a} | own)
                        if len(out) >= PIECES:
                            yield pa.RecordBatch.from_pylist(out, _arrow(_PIECE))
                            out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, _arrow(_PIECE))

    return partitions.select("type", "cluster", "geometry", "x0", "y0", "x1", "y1").mapInArrow(run, _PIECE)


def _lifted(cut: DataFrame, levels: list[int], own: bool) -> DataFrame:
    """Each piece for its cell and for all wider cells that hold it (only those, unless own), of the levels that occur: columns at, cx, cy."""
    at = F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("level") if own else x > F.col("level"))
    up = lambda k: F.floor(F.col(k) * F.pow(F.lit(2.0), F.col("level") - F.col("at"))).cast("long")
    return cut.withColumn("at", F.explode(at)).withColumn("cx", up("kx")).withColumn("cy", up("ky"))


def _levels(cut: DataFrame) -> list[int]:
    """One value for each doubling of the width of polygons, so a few tens."""
    return sorted(r[0] for r in cut.select("level").distinct().collect())


def _is_box() -> Column:
    return F.col("area") == (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))


def polygon_overlaps(partitions: DataFrame, dag: DataFrame) -> DataFrame:
    """source_type, source_cluster, target_type, target_cluster of polygons (as clean_partitions gives them) of types that the graph
    joins and that share an area; a common edge or corner is none.

    A polygon that is a box stays whole; others are cut along a grid by their own width. Boxes of what is compared meet on grids that nest, in cells that
    are as wide as the wider of the two, once a pair: where the lower left corner of what the boxes share lies. That decides between boxes; of others the
    shared area is integrated exactly. A broadcast of pairs of types, at most sectors squared, keeps types apart that the graph does not join."""
    corners = ["x0", "y0", "x1", "y1"]
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    rows = partitions.where(_is_box()).select("type", "cluster", "area", *corners, F.lit(None).cast("binary").alias("piece"), F.lit(True).alias("whole"))
    cut = materialize(pieces(partitions.where(~_is_box())), "partition-pieces")
    split = not cut.isEmpty()
    if split:
        rows = rows.unionByName(cut.select("type", "cluster", "area", *corners, F.when(~_is_box(), F.col("piece")).alias("piece"), F.lit(False).alias("whole")))
    rows = materialize(dealt(rows.withColumn("level", F.ceil(F.log2(extent)).cast("long"))), "partition-boxes")
    levels = _levels(rows)
    width = F.pow(F.lit(2.0), F.col("at"))
    number = lambda c: F.floor(c / width).cast("long")
    cells = lambda a, b: F.explode(F.sequence(number(F.col(a)), number(F.col(b))))
    every = rows.withColumn("at", F.explode(F.filter(F.array(*[F.lit(k).cast("long") for k in levels]), lambda x: x >= F.col("level"))))
    every = every.withColumn("cx", cells("x0", "x1")).withColumn("cy", cells("y0", "y1")).withColumn("own", F.col("at") == F.col("level"))
    keys = ["source_type", "source_cluster", "target_type", "target_cluster"]
    pairs = F.broadcast(dag.select("source_type", "target_type").distinct())

    def met(of: DataFrame, with_: DataFrame) -> DataFrame:
        side = lambda df, s: df.select(F.col("type").alias(f"{s}_type"), F.col("cluster").alias(f"{s}_cluster"), "at", "cx", "cy", *[F.col(c).alias(f"{s}_{c}") for c in ("own", "area", "piece", *corners)])
        found = side(of, "source").join(pairs, "source_type").join(side(with_, "target"), ["target_type", "at", "cx", "cy"]).where("source_own or target_own")
        for low, high, cell in (("x0", "x1", "cx"), ("y0", "y1", "cy")):
            begin, end = (f(F.col(f"source_{c}"), F.col(f"target_{c}")) for f, c in ((F.greatest, low), (F.least, high)))
            narrower = F.least(F.col(f"source_{high}") - F.col(f"source_{low}"), F.col(f"target_{high}") - F.col(f"target_{low}"))
            found = found.where((number(begin) == F.col(cell)) & (end - begin > LEAST_SHARE * narrower))
        return found

    whole = met(every.where("whole"), every.where("whole")).select(*keys)
    if not split:
        return whole
    rest = met(every.where("not whole"), every).unionByName(met(every.where("whole"), every.where("not whole")))
    given = [f"{s}_{c}" for s in ("source", "target") for c in ("piece", *corners)]
    rest = rest.select(*keys, *given, F.least("source_area", "target_area").alias("least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = lambda p, a, b, c, d: polygons_of(read_wkb(p)) if p else [[[(a, b), (c, b), (c, d), (a, d), (a, b)]]]
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in (*given, "least")), strict=True)
            keep = [r[0] is r[5] is None or overlap_area(shape(*r[:5]), shape(*r[5:10])) > LEAST_SHARE * r[10] for r in rows]
            yield b.select(keys).filter(pa.array(keep, pa.bool_()))

    return whole.unionByName(rest.mapInArrow(run, rest.select(*keys).schema).distinct())


def _united(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """One piece for each key, the union of its pieces. At most MEET of them meet in a task; where there are more, their unions meet next."""
    schema = StructType([*[rows.schema[k] for k in keys], StructField("piece", BinaryType())])

    def unite(t: pa.Table) -> pa.Table:
        whole = union([p for g in t.column("piece").to_pylist() for p in polygons_of(read_wkb(g))]) if len(t) > 1 else None
        return t.slice(0, 1).select([*keys, "piece"]) if whole is None else pa.table([*(t.column(k).slice(0, 1) for k in keys), pa.array([multipolygon_wkb(whole)], pa.binary())], names=[*keys, "piece"])

    rows = rows.select(*keys, "piece").distinct()
    while True:
        sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / MEET).alias("parts"))
        one = (sizes.agg(F.max("parts")).first()[0] or 1) <= 1
        parted = rows.withColumn("part", F.lit(0)) if one else rows.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("piece"), F.col("parts"))).drop("parts")
        rows = materialize(parted.groupBy(*keys, "part").applyInArrow(unite, schema), tag)
        if one:
            return rows


def disjoint_parts(partitions: DataFrame) -> DataFrame:
    """type, level, kx, ky, piece, area: what the polygons of a type (as clean_partitions gives them) cover together, in parts that share no area.

    Pieces of one cell are united; from a cell's union goes what wider polygons cover of it. So wide polygons are never cut as finely as narrow
    ones, and no task holds more than a cell's pieces."""
    cut = materialize(pieces(partitions, COARSE), "union-pieces")
    keys = ["type", "level", "kx", "ky"]
    whole = _united(cut, keys, "union-cells")
    wider = whole.select("type", F.col("level").alias("at"), F.col("kx").alias("cx"), F.col("ky").alias("cy"), F.col("piece").alias("over"))
    over = _lifted(whole.select(*keys), _levels(cut), False).join(wider, ["type", "at", "cx", "cy"]).groupBy(*keys).agg(F.collect_list("over").alias("over"))  # one for each level
    schema = StructType([*[whole.schema[k] for k in keys], StructField("piece", BinaryType()), StructField("area", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for level, kx, ky, piece, over in zip(*(b.column(c).to_pylist() for c in ("level", "kx", "ky", "piece", "over")), strict=True):
                part, size = polygons_of(read_wkb(piece)), 2.0**level
                if over:
                    box = (kx * size, ky * size, (kx + 1) * size, (ky + 1) * size)
                    part = difference(part, [q for g in over for q in clip(polygons_of(read_wkb(g)), box)])
                out.append((multipolygon_wkb(part), area(part)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.float64())], names=schema.names)

    return dealt(whole.join(over, keys, "left")).mapInArrow(run, schema).where("area > 0")


def dissolve(partitions: DataFrame) -> DataFrame:
    """type, geometry, area: one geometry for each type, what its polygons cover together. Parts of neighbouring cells are united in cells four
    times as wide, and so on, so borders between cells vanish where they are; the last rows are the geometries themselves."""
    parts = materialize(disjoint_parts(partitions), "dissolve-parts")
    total = parts.groupBy("type").agg(F.sum("area").alias("area"))
    level = max(_levels(parts), default=0)
    rows = parts
    while not rows.groupBy("type").count().where("count > 1").isEmpty():
        level += 2
        up = lambda k, to=level: F.floor(F.col(k) * F.pow(F.lit(2.0), F.col("level") - to)).cast("long").alias(k)
        rows = _united(rows.select("type", F.lit(level).cast("long").alias("level"), up("kx"), up("ky"), "piece"), ["type", "level", "kx", "ky"], "dissolve-cells")
        low_x, high_x, low_y, high_y = rows.agg(F.min("kx"), F.max("kx"), F.min("ky"), F.max("ky")).first()
        if min(low_x, low_y) >= -1 and max(high_x, high_y) <= 0:  # cells on both sides of zero never share a wider one
            rows = _united(rows.select("type", "piece"), ["type"], "dissolved")
            break
    return rows.select("type", F.col("piece").alias("geometry")).join(total, "type")


def outline_facts(geometries: DataFrame) -> DataFrame:
    """type, area (of the rings) and valid, for geometries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [polygons_of(read_wkb(g)) for g in b.column("geometry").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("type"), pa.array([area(f) for f in found], pa.float64()), pa.array([invalid(f) is None for f in found], pa.bool_())], names=["type", "area", "valid"])

    return geometries.select("type", "geometry").mapInArrow(run, "type string, area double, valid boolean")
