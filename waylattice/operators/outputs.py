"""Public artifacts: tables of the cluster graph, outlines of territories, layers, descriptions."""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..functions.geometry import line_wkb, multipolygon_wkb, outline, point_wkb, polygons_of, read_wkb, to_wgs84
from ..functions.overlay import cut
from ..functions.sectors import node_id
from ..sources.vectors import write_geopackage


def partitions_of(cells: DataFrame, origin: tuple[float, float], resolution: float, split: int = 2, box: tuple[float, float, float, float] | None = None, boundary=None) -> DataFrame:
    """type, cluster, geometry: the outline of each territory, one territory in memory at a time. Corners beyond the boundary's box
    move onto it. With a boundary (polygons, a geometry that every task gets), outlines are cut along it, its holes included."""
    schema = StructType([StructField("type", StringType()), StructField("cluster", LongType()), StructField("geometry", BinaryType())])
    grouped = cells.groupBy("type", "cluster", "level").agg(F.collect_list(F.struct("ix", "iy")).alias("cells"))  # max_cells at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for level, own in zip(b.column("level").to_pylist(), b.column("cells").to_pylist(), strict=True):
                size = resolution / split**level
                place = lambda p, size=size: tuple(min(max(origin[k] + p[k] * size, box[k]), box[k + 2]) if box else origin[k] + p[k] * size for k in (0, 1))
                found = [[[place(p) for p in ring] for ring in polygon] for polygon in outline((c["ix"], c["iy"]) for c in own)]
                out.append(multipolygon_wkb(cut(found, boundary) if boundary else found))
            yield pa.RecordBatch.from_arrays([b.column("type"), b.column("cluster"), pa.array(out, pa.binary())], names=schema.names)

    return grouped.mapInArrow(run, schema)


def x_node_rows(nodes: DataFrame, epsg: int) -> list[dict]:
    """Nodes by id, as text, with longitude and latitude; a row for each cluster."""
    out = []
    for r in nodes.orderBy("node_id").collect():
        lon, lat = to_wgs84(r["x"], r["y"], epsg)
        out.append({"node_id": r["node_id"], "type": r["type"], "cluster": r["cluster"], "cluster_no": r["cluster"] + 1, "lat": lat, "lon": lon, "in_degree": r["in_degree"], "out_degree": r["out_degree"], "centrality": r["centrality"]})
    return out


def path_points(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """source_id, target_id, coords: the corners of each edge's road path, in order; a path of one node has it twice."""
    steps = edges.select("source_id", "target_id", F.posexplode("road_path").alias("pos", "node"))
    placed = steps.join(nodes.select("node", "x", "y"), "node")
    coords = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return placed.groupBy("source_id", "target_id").agg(coords.alias("coords")).withColumn("coords", F.when(F.size("coords") == 1, F.concat("coords", "coords")).otherwise(F.col("coords")))


def x_edge_rows(edges: DataFrame) -> list[dict]:
    keep = ("source_type", "source_cluster", "target_type", "target_cluster", "technical_coefficient", "road_distance", "edge_weight")
    return [{c: r[c] for c in keep} for r in edges.orderBy("source_id", "target_id").collect()]


def layers(partitions: DataFrame, nodes: DataFrame, edges: DataFrame, road_nodes: DataFrame, epsg: int) -> dict:
    """The layers of the GeoPackage in WGS 84: clusters, nodes, paths."""
    wgs = lambda p: to_wgs84(p[0], p[1], epsg)
    clusters = [
        {"type": r["type"], "cluster": r["cluster"], "geometry": multipolygon_wkb([[[wgs(p) for p in ring] for ring in poly] for poly in polygons_of(read_wkb(bytes(r["geometry"])))])}
        for r in partitions.orderBy("type", "cluster").collect()
    ]
    points = [{**r, "geometry": point_wkb(r["lon"], r["lat"])} for r in x_node_rows(nodes, epsg)]
    lines = {(r["source_id"], r["target_id"]): line_wkb([wgs((p["x"], p["y"])) for p in r["coords"]]) for r in path_points(edges, road_nodes).collect()}
    paths = [
        {"source_type": r["source_type"], "source_cluster": r["source_cluster"], "target_type": r["target_type"], "target_cluster": r["target_cluster"], "road_distance": r["road_distance"], "edge_weight": r["edge_weight"], "geometry": lines[r["source_id"], r["target_id"]]}
        for r in edges.orderBy("source_id", "target_id").collect()
    ]
    return {"clusters": (clusters, "MULTIPOLYGON"), "nodes": (points, "POINT"), "paths": (paths, "LINESTRING")}


def write_csv(rows: list[dict], columns: tuple[str, ...], path: str) -> str:
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, columns)
        w.writeheader()
        w.writerows(rows)
    return path


def write_frame_csv(df: DataFrame, path: str, order: list[str]) -> str:
    return write_csv([r.asDict() for r in df.orderBy(*order).collect()], tuple(df.columns), path)


def write_metadata(metadata: dict, path: str) -> str:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(metadata, f, indent=2, sort_keys=True, default=str)
        f.write("\n")
    return path


def write_description(metadata: dict, files: dict[str, str], path: str) -> str:
    """What the files of a run hold, and its figures."""
    about = {
        "clustered_points": "all points with their cluster (-1: none) and membership", "network_centers": "the network median of each cluster", "points_with_center_distance": "clustered points with the road distance to their median",
        "partitions": "the territory of each cluster", "io_dag": "the acyclic graph of sectors", "x_nodes": "clusters with degrees and centrality", "x_edges": "joined clusters with coefficient, road distance and weight",
        "disconnected": "overlapping clusters that no road joins", "points_centrality": "points with their score", "spatial_outputs": "clusters, nodes and paths as map layers", "metadata": "parameters and figures of the run",
    }
    with open(path, "w", encoding="utf-8") as f:
        f.write("Files\n")
        for name, file in files.items():
            f.write(f"  {os.path.basename(file)}: {about.get(name, name)}\n")
        f.write("\nFigures\n")
        for k in sorted(metadata):
            v = metadata[k]
            f.write(f"  {k}: {f'{v:,}' if isinstance(v, int) and not isinstance(v, bool) else f'{v:,.6g}' if isinstance(v, float) else v}\n")
    return path


def restore_x(spark: SparkSession, nodes_path: str, edges_path: str, disconnected_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cluster graph from its CSV files, also with the older column names. Types are read as text, so that 01 stays."""
    read = lambda p: spark.read.option("header", True).csv(p)
    pick = lambda df, *names: F.coalesce(*[F.col(n) for n in names if n in df.columns])
    n, e, d = read(nodes_path), read(edges_path), read(disconnected_path)
    nodes = n.select("node_id", F.col("type"), F.col("cluster").cast("long").alias("cluster"))
    if "node_from" in e.columns:
        edges = e.select(F.col("node_from").alias("source_id"), F.col("node_to").alias("target_id"), F.col("dag_weight").cast("double").alias("technical_coefficient"), F.col("road_distance").cast("double").alias("road_distance"), pick(e, "weight", "edge_weight").cast("double").alias("edge_weight"))
    else:
        ids = [node_id(F.col(f"{s}_type"), F.col(f"{s}_cluster").cast("long")).alias(f"{s}_id") for s in ("source", "target")]
        edges = e.select(*ids, *[F.col(c).cast("double").alias(c) for c in ("technical_coefficient", "road_distance", "edge_weight")])
    t = [("source_type", "type1"), ("source_cluster", "cluster1"), ("target_type", "type2"), ("target_cluster", "cluster2"), ("reason", "status")]
    return nodes, edges, d.select(*[pick(d, *names).alias(names[0]) for names in t])


def write_layers(path: str, partitions: DataFrame, nodes: DataFrame, edges: DataFrame, road_nodes: DataFrame, epsg: int) -> str:
    return write_geopackage(path, layers(partitions, nodes, edges, road_nodes, epsg))
