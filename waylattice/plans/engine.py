"""The workflow over tables: from points, roads, a boundary and the economy to scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import density, io_graph, median, points as pts, roads, scoring, surface, xgraph
from ..operators.storage import materialize


@dataclass
class Workflow:
    """Tables of a run, by step."""

    clustered: DataFrame | None = None
    centers: DataFrame | None = None
    distances: DataFrame | None = None
    cells: DataFrame | None = None
    dag: DataFrame | None = None
    audit: DataFrame | None = None
    x_nodes: DataFrame | None = None
    x_edges: DataFrame | None = None
    disconnected: DataFrame | None = None
    scores: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    summary: DataFrame | None = None
    trace: DataFrame | None = None
    metadata: dict = field(default_factory=dict)


def score_points(
    spark: SparkSession, points: DataFrame, lines: DataFrame, boundary, z: DataFrame, a: DataFrame, clustering: density.ClusteringConfig, surface_config: surface.SurfaceConfig,
    mwas: str = "fast", tempering: float = 0.15, digits: int = 11, max_snap: float | None = None, progress=None,
) -> Workflow:
    """points: point_id, type, x, y and more. The clusters' territories and medians don't depend on each other."""
    w = Workflow()
    vertices, arcs = roads.build_network(lines, digits)
    snapped = materialize(roads.snap(points, vertices, arcs), "snapped")
    pts.check_snaps(snapped, max_snap)
    pts.check_types(points, z)
    places, _ = roads.positions(snapped)
    clustered, w.summary, w.trace = density.cluster_by_type(roads.positioned(snapped, places), places, None, arcs, clustering, progress)
    w.clustered = materialize(clustered, "clustered")
    kept = pts.retained(w.clustered)
    if kept.isEmpty():
        raise ValueError("no clusters")
    w.nodes, w.edges, kept = roads.inserted(vertices, arcs, kept)
    w.centers = materialize(median.cluster_medians(kept, w.nodes, w.edges), "centers")
    w.distances = median.median_distances(kept, w.centers, w.edges)
    w.cells = surface.territories(kept, w.nodes, w.edges, boundary, surface_config, progress)
    return late_steps(spark, w, z, a, w.edges, mwas, tempering, surface_config.split)


def late_steps(spark: SparkSession, w: Workflow, z: DataFrame, a: DataFrame, edges: DataFrame, mwas: str, tempering: float, split: int = 2, overlap: Callable[[DataFrame], DataFrame] | None = None) -> Workflow:
    """The economy's graph, the graph of clusters, centrality and scores; the same for a whole run and a restart.

    overlap: given the economy's graph, which territories overlap, where they aren't cells."""
    w.dag, w.audit = io_graph.build_dag(spark, z, a, mwas)
    w.dag = materialize(w.dag, "dag")
    if overlap is None:
        keys = ["type", "cluster"]
        clusters = pts.check_clusters(w.distances, w.centers, w.cells.select(*keys).distinct())
        met = surface.overlaps(w.cells, w.dag, split)
    else:
        clusters, met = w.centers.count(), overlap(w.dag)
    nodes, w.x_edges, w.disconnected = xgraph.cluster_graph(w.centers, w.dag, materialize(met, "overlaps"), edges)
    w.x_edges, w.disconnected = materialize(w.x_edges, "x-edges"), materialize(w.disconnected, "disconnected")
    values = xgraph.centrality(nodes, w.x_edges)
    w.x_nodes = materialize(xgraph.degrees(nodes, w.x_edges).join(values, "node_id"), "x-nodes")
    if w.x_nodes.count() != clusters:
        raise ValueError("the graph must have a node for each cluster")
    w.scores = materialize(scoring.tempered_scores(w.distances, w.x_nodes.select("type", "cluster", "centrality"), tempering), "scores")
    scoring.check_bounds(w.scores)
    w.metadata |= {"cluster_count": clusters, "mwas_method": mwas, "distance_tempering": tempering} | summary_of(w.x_nodes, w.x_edges)
    return w


def summary_frame(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: types, clusters by type (least, median, most), degrees and road distances."""
    by_type = nodes.groupBy("type").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("types"), F.min("n").alias("clusters_min"), F.percentile("n", 0.5).alias("clusters_median"), F.max("n").alias("clusters_max")
    )
    degree = nodes.agg(F.max(F.col("in_degree") + F.col("out_degree")).alias("degree_max"), F.avg(F.col("in_degree") + F.col("out_degree")).alias("degree_mean"))
    route = edges.agg(F.count("*").alias("routes"), F.sum("road_distance").alias("route_sum"), F.min("road_distance").alias("route_min"), F.percentile("road_distance", 0.5).alias("route_median"), F.max("road_distance").alias("route_max"))
    one = F.lit(1).alias("one_")
    return by_type.select("*", one).join(degree.select("*", one), "one_").join(route.select("*", one), "one_").drop("one_")


def summary_of(nodes: DataFrame, edges: DataFrame) -> dict:
    return summary_frame(nodes, edges).first().asDict()
