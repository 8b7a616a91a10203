"""Runs over files: the whole workflow, and the restart from saved territories."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .. import __version__
from ..functions.geometry import is_box, point_wkb
from ..functions.sectors import sector_id
from ..operators import density, outputs, points as pts, polygons, roads, surface
from ..operators.storage import materialize, require
from ..sources.iotable import SECTORS, load_pair
from ..sources.vectors import boundary_of, lines_of, points_of, read_vector, write_geoparquet
from .engine import Workflow, late_steps, score_points


@dataclass(frozen=True)
class EngineConfig:
    roads_path: str
    boundary_path: str
    output_dir: str
    points_path: str
    technical_coefficients_path: str | None = None
    classification: str = "io80"
    transactions_path: str | None = None
    classification_column: str | None = None
    roads_layer: str | None = None
    boundary_layer: str | None = None
    transactions_sheet: str | int = 0
    technical_coefficients_sheet: str | int = 0
    io_data: str | None = None
    mwas_method: str = "fast"
    clustering: density.ClusteringConfig = field(default_factory=density.ClusteringConfig)
    surface: surface.SurfaceConfig = field(default_factory=surface.SurfaceConfig)
    vertex_digits: int = 11
    max_snap_distance: float | None = None
    centrality_direction: str = "incoming"
    distance_tempering: float = 0.15
    progress: Callable[[str], None] | None = None
    area_slug: str | None = None
    area_name: str | None = None

    def __post_init__(self):
        _check(self)


@dataclass(frozen=True)
class ContinueConfig:
    roads_path: str
    partitions_path: str
    output_dir: str
    technical_coefficients_path: str | None = None
    centers_path: str | None = None
    points_path: str | None = None
    classification: str = "io80"
    transactions_path: str | None = None
    roads_layer: str | None = None
    transactions_sheet: str | int = 0
    technical_coefficients_sheet: str | int = 0
    io_data: str | None = None
    mwas_method: str = "fast"
    vertex_digits: int = 11
    centrality_direction: str = "incoming"
    distance_tempering: float = 0.15
    progress: Callable[[str], None] | None = None

    def __post_init__(self):
        _check(self)


@dataclass
class EngineResult:
    points: DataFrame
    centers: DataFrame
    partitions: DataFrame
    output_paths: dict[str, str]
    metadata: dict


def _check(c) -> None:
    if c.classification not in SECTORS or c.mwas_method not in ("fast", "exact") or c.centrality_direction not in ("incoming", "outgoing"):
        raise ValueError("classification is io16 or io80, the method fast or exact, the direction incoming or outgoing")
    if not 0 <= c.distance_tempering < 1 or not 1 <= c.vertex_digits <= 15:
        raise ValueError("tempering lies between 0 and 1, vertex digits between 1 and 15")


def _file(path: str | None, what: str) -> str:
    if not path or not os.path.exists(path):
        raise FileNotFoundError(f"{what}: {path}")
    return path


def _projected(epsg: int | None) -> int:
    if epsg is None or epsg == 4326:
        raise ValueError("roads need a projected reference system")
    return epsg


def _with_wkb(df: DataFrame) -> DataFrame:
    """geometry, as WKB, from x and y."""
    schema = StructType([*df.schema.fields, StructField("geometry", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = [point_wkb(x, y) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(g, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def _write_late(w: Workflow, partitions: DataFrame, road_nodes: DataFrame, out: str, epsg: int, metadata: dict) -> dict[str, str]:
    at = lambda name: os.path.join(out, name)
    files = {
        "io_dag": outputs.write_frame_csv(w.dag, at("io_dag.csv"), ["source_type", "target_type"]),
        "x_nodes": outputs.write_csv(outputs.x_node_rows(w.x_nodes, epsg), ("node_id", "type", "cluster", "cluster_no", "lat", "lon", "in_degree", "out_degree", "centrality"), at("X_nodes.csv")),
        "x_edges": outputs.write_csv(outputs.x_edge_rows(w.x_edges), ("source_type", "source_cluster", "target_type", "target_cluster", "technical_coefficient", "road_distance", "edge_weight"), at("X_edges.csv")),
        "disconnected": outputs.write_frame_csv(w.disconnected, at("disconnected_overlap_pairs.csv"), ["source_type", "source_cluster", "target_type", "target_cluster"]),
    }
    names = [c for c in ("canonical_id", "canonical_name") if c in w.scores.columns]
    columns = ["point_id", "type", "cluster", "cluster_centrality", "distance_to_cluster_median", "cluster_distance_p90", "normalized_cluster_distance", "distance_tempering", "score", *names]
    files["points_centrality"] = write_geoparquet(_with_wkb(w.scores.select(*columns, "x", "y")).drop("x", "y"), at("points_centrality.parquet"), epsg)
    files["spatial_outputs"] = outputs.write_layers(at("spatial_outputs.gpkg"), partitions, w.x_nodes, w.x_edges, road_nodes, epsg)
    audit = w.audit.first().asDict()
    metadata |= w.metadata | {"version": __version__, "centrality_direction": "undirected", "road_distance_crs": f"EPSG:{epsg}", "scored_points": w.scores.count(), "disconnected_overlap_pairs": w.disconnected.count(), "x_nodes": w.x_nodes.count(), "x_edges": w.x_edges.count()}
    metadata |= {"mwas_solver_method": audit["method"], "mwas_exact": audit["method"] != "fast_greedy", "mwas_source_edges": audit["source_edges"], "mwas_retained_edges": audit["retained_edges"]}
    files["metadata"] = outputs.write_metadata(metadata, at("run_metadata.json"))
    outputs.write_description(metadata, files, at("OUTPUTS.txt"))
    return files


def run_engine(spark: SparkSession, c: EngineConfig) -> EngineResult:
    """The whole workflow from files to files."""
    for path, what in ((c.points_path, "points"), (c.roads_path, "roads"), (c.boundary_path, "boundary")):
        _file(path, what)
    z, a, found = load_pair(spark, c.classification, c.transactions_path, c.transactions_sheet, c.technical_coefficients_path, c.technical_coefficients_sheet, c.io_data)
    lines, epsg = read_vector(spark, c.roads_path, c.roads_layer)
    epsg = _projected(epsg)
    raw, points_epsg = read_vector(spark, c.points_path)
    column = pts.classification_column(raw, c.classification, c.classification_column)
    prepared = materialize(pts.prepare_points(points_of(raw, points_epsg, epsg), c.classification, c.classification_column).withColumn("point_id", F.col("canonical_id")), "points")
    area, area_epsg = read_vector(spark, c.boundary_path, c.boundary_layer)
    boundary = boundary_of(area, area_epsg, epsg)
    w = score_points(spark, prepared, lines_of(lines), boundary, z, a, c.clustering, c.surface, c.mwas_method, c.distance_tempering, c.vertex_digits, c.max_snap_distance, c.progress)
    os.makedirs(c.output_dir, exist_ok=True)
    at = lambda name: os.path.join(c.output_dir, name)
    xs, ys = [x for p in boundary for x, _ in p[0]], [y for p in boundary for _, y in p[0]]
    partitions = materialize(outputs.partitions_of(w.cells, (min(xs), min(ys)), c.surface.resolution, c.surface.split, (min(xs), min(ys), max(xs), max(ys)), None if is_box(boundary) else boundary), "partitions")
    names = ["canonical_id", "canonical_name"]
    clustered = w.clustered.select("point_id", "type", "cluster", "membership", *names, F.col("component").alias("network_component"), F.col("snap_distance").alias("snap_distance_to_network"), F.col("arc_id").alias("snapped_edge_id"), F.col("position").alias("network_position"), "x", "y")
    files = {
        "clustered_points": write_geoparquet(_with_wkb(clustered).drop("x", "y"), at("clustered_points.parquet"), epsg),
        "network_centers": write_geoparquet(_with_wkb(pts.clean_centers(w.centers)).drop("x", "y"), at("network_centers.parquet"), epsg),
        "points_with_center_distance": write_geoparquet(_with_wkb(w.distances.select("point_id", "type", "cluster", "distance_to_cluster_median", "point_center_distance_method", *names, "x", "y")).drop("x", "y"), at("points_with_center_distance.parquet"), epsg),
        "partitions": write_geoparquet(partitions.orderBy("type", "cluster"), at("partitions.parquet"), epsg),
    }
    # the exact form of the territories, for a restart of our own
    w.cells.coalesce(1).write.mode("overwrite").parquet(at("partition_cells.parquet"))
    metadata = {"entrypoint": "run", "classification": c.classification, "classification_column": column, "transactions_source": found.source_id, "transactions_kind": found.source_kind, "transactions_sha256": found.resource_sha256, "area_slug": c.area_slug, "area_name": c.area_name}
    files |= _write_late(w, partitions, w.nodes, c.output_dir, epsg, metadata)
    return EngineResult(w.scores, w.centers, partitions, files, metadata)


def run_from_partitions(spark: SparkSession, c: ContinueConfig) -> EngineResult:
    """Steps from the economy's graph on, from saved points, centers and territories. The roads are built again, with decimal digits,
    and the saved centers are snapped to them; saved node numbers are not used. Territories of a run of our own are read as cells, beside
    the outlines; polygons of anyone else are checked, and overlap where they share an area."""
    folder = os.path.dirname(os.path.abspath(_file(c.partitions_path, "partitions")))
    cells_path = os.path.join(folder, "partition_cells.parquet")
    centers_path = _file(c.centers_path or os.path.join(folder, "network_centers.parquet"), "centers")
    points_path = _file(c.points_path or os.path.join(folder, "points_with_center_distance.parquet"), "points")
    z, a, found = load_pair(spark, c.classification, c.transactions_path, c.transactions_sheet, c.technical_coefficients_path, c.technical_coefficients_sheet, c.io_data)
    lines, epsg = read_vector(spark, _file(c.roads_path, "roads"), c.roads_layer)
    epsg = _projected(epsg)
    raw_centers, centers_epsg = read_vector(spark, centers_path)
    centers = materialize(pts.clean_centers(points_of(raw_centers, centers_epsg, epsg)), "centers")
    raw_points, points_epsg = read_vector(spark, points_path)
    points = pts.restart_points(points_of(raw_points, points_epsg, epsg))
    raw_partitions, partitions_epsg = read_vector(spark, c.partitions_path)
    partitions = polygons.clean_partitions(raw_partitions, partitions_epsg, epsg)
    cells = None
    if os.path.exists(cells_path):
        cells = spark.read.parquet(cells_path).withColumn("type", sector_id(F.col("type")))
        surface.check_territories(cells)
    points, dropped = pts.align_restart(points, centers, partitions)
    pts.check_clusters(points, centers, partitions)
    vertices, arcs = roads.build_network(lines_of(lines), c.vertex_digits, True)
    named = centers.withColumn("point_id", F.concat_ws("/", "type", F.col("cluster").cast("string")))
    snapped = materialize(roads.snap(named, vertices, arcs, True), "center-snaps")
    farthest = snapped.agg(F.max("snap_distance")).first()[0]
    nodes, edges, of = roads.augment(vertices, arcs, snapped)
    require(named.join(of, "point_id", "left_anti").select("point_id"), "centers without a road")
    w = Workflow()
    w.centers = materialize(named.drop("center_network_node").join(of, "point_id").select("type", "cluster", F.col("node").alias("center_network_node"), "x", "y"), "centers")
    w.distances, w.cells, w.nodes, w.edges = materialize(points, "points"), cells, nodes, edges
    overlap = None if cells is not None else lambda dag: polygons.polygon_overlaps(partitions, dag)
    late_steps(spark, w, z, a, edges, c.mwas_method, c.distance_tempering, overlap=overlap)
    os.makedirs(c.output_dir, exist_ok=True)
    metadata = {"entrypoint": "from-partitions", "classification": c.classification, "transactions_source": found.source_id, "partitions_path": c.partitions_path, "centers_path": centers_path, "points_path": points_path, "maximum_center_resnap_distance": farthest, "extra_point_rows_dropped": dropped}
    partitions = partitions.select("type", "cluster", "geometry")
    files = _write_late(w, partitions, nodes, c.output_dir, epsg, metadata)
    return EngineResult(w.scores, w.centers, partitions, files, metadata)
