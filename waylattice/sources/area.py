"""Areas of a catalog: definition, boundary, and the handoff from a producer of points."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import multipolygon_wkb, polygons_of, read_wkb
from .vectors import read_vector, united, write_geopackage


@dataclass(frozen=True)
class Area:
    slug: str
    name: str
    kind: str
    bbox: tuple[float, float, float, float] | None
    boundary_path: str | None = None
    boundary_layer: str | None = None
    boundary_field: str | None = None
    boundary_values: tuple[str, ...] = ()


def load_area(value: str, catalog: str) -> Area:
    """The area whose slug, name or alias is the value, whatever its case; exactly one must be."""
    with open(catalog, encoding="utf-8") as f:
        areas = (yaml.safe_load(f) or {}).get("areas") or {}
    wanted = value.strip().casefold()
    found = [s for s, a in areas.items() if wanted in {s.casefold(), str(a.get("name", s)).casefold(), *(str(x).casefold() for x in a.get("aliases") or ())}]
    if len(found) != 1:
        raise ValueError(f"{len(found)} areas are called {value}" if found else f"no area is called {value}")
    a = areas[found[0]]
    box = tuple(map(float, a["bbox"])) if a.get("bbox") else None
    if box and not (len(box) == 4 and box[0] < box[2] and box[1] < box[3]):
        raise ValueError("a bbox is west, south, east, north")
    b = a.get("boundary") or {}
    values = b.get("value", b.get("values", ()))
    values = tuple(map(str, values)) if isinstance(values, (list, tuple)) else (str(values),)
    path = b.get("gpkg")
    if path and not os.path.isabs(path):
        path = os.path.join(os.path.dirname(os.path.abspath(catalog)), path)
    if not box and not path:
        raise ValueError("an area needs a bbox or a boundary")
    return Area(found[0], str(a.get("name", found[0])), str(a.get("kind", "")), box, path, b.get("layer"), b.get("field"), values)


def _same(value: F.Column) -> F.Column:
    """A field's value for comparison: trimmed, without a zero decimal, and for numbers without leading zeros."""
    t = F.regexp_replace(F.trim(value.cast("string")), r"\.0$", "")
    return F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=[0-9])", "")).otherwise(t)


def area_boundary(spark: SparkSession, area: Area, target: str) -> str:
    """A GeoPackage with the boundary's features of the area, or its bbox, united as one multipolygon."""
    if area.boundary_path:
        df, epsg = read_vector(spark, area.boundary_path, area.boundary_layer)
        if area.boundary_field:
            wanted = spark.createDataFrame([(v,) for v in area.boundary_values], "v string").select(_same(F.col("v")).alias("v"))
            df = df.join(F.broadcast(wanted), _same(F.col(area.boundary_field)) == F.col("v"), "left_semi")
        polygons = [p for r in df.select("geometry").collect() if r[0] for p in polygons_of(read_wkb(bytes(r[0])))]
        if not polygons:
            raise ValueError(f"no boundary of {area.slug}")
    else:
        w, s, e, n = area.bbox
        polygons, epsg = [[[(w, s), (e, s), (e, n), (w, n), (w, s)]]], 4326
    return write_geopackage(target, {"boundary": ([{"geometry": multipolygon_wkb(united(polygons)), "name": area.name}], "MULTIPOLYGON")}, epsg or 4326)


def check_area_points(points: DataFrame, classification: str) -> None:
    """A producer's points have ids, classes and geometry, and some are classified."""
    column = next((c for c in (f"{classification}_code", f"{classification}_map_code") if c in points.columns), None)
    if not column or "canonical_id" not in points.columns or "geometry" not in points.columns:
        raise ValueError("the points lack an id, a class or a geometry")
    if points.where(F.col(column).isNotNull()).isEmpty():
        raise ValueError("no point is classified")


def area_points(spark: SparkSession, area: Area, folder: str, classification: str, produce: Callable[[Area, str], None] | None = None, refresh: bool = False) -> tuple[str, bool]:
    """The points file of an area in a producer's folder, and whether it was produced now. Existing output is used if its run record
    names the area; else `produce` makes it."""
    path, record = os.path.join(folder, area.slug, "points.parquet"), os.path.join(folder, area.slug, "run.json")
    made = False
    if refresh or not os.path.exists(path):
        if produce is None:
            raise FileNotFoundError(f"no points of {area.slug} in {folder}")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        produce(area, os.path.dirname(path))
        made = True
    if os.path.exists(record):
        with open(record, encoding="utf-8") as f:
            if (slug := json.load(f).get("area")) not in (None, area.slug):
                raise ValueError(f"{record} is of area {slug}")
    check_area_points(read_vector(spark, path)[0], classification)
    return path, made
