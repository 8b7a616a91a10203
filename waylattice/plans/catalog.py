"""Registered queries of the engine over tables derived from the star schema, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import polygon_wkb
from ..functions.sectors import node_id, sector_id
from ..operators import density, io_graph, median, paths, planar, points, polygons, roads, scoring, surface, xgraph
from ..operators.storage import materialize, ship
from ..sources import derived
from .oracles import ORACLES

#: Parameters of the registered queries on the derived network, whose lattice has a spacing of 50.
RADIUS, CONFIG, SURFACE = 60.0, density.ClusteringConfig(max_distance=300.0), surface.SurfaceConfig(resolution=derived.RESOLUTION)
BOX = derived.BOUNDARY
BOUNDARY = [[[(BOX[0], BOX[1]), (BOX[2], BOX[1]), (BOX[2], BOX[3]), (BOX[0], BOX[3]), (BOX[0], BOX[1])]]]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


# --- economy ---


def _z(spark, sf_dir) -> DataFrame:
    """Written, as it is a row for each pair of sectors, and the order lines are read once for all that use it."""
    return materialize(derived.io_z(spark, sf_dir).select("source", "target", F.col("cents").cast("double").alias("value")), "derived-z")


def _economy(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Transactions and output, both from one reading of the order lines."""
    cents = materialize(derived.io_z(spark, sf_dir), "derived-z")
    x = derived.io_x(spark, sf_dir, cents)
    return cents.select("source", "target", F.col("cents").cast("double").alias("value")), materialize(x.select("sector", F.col("cents").cast("double").alias("total_output")), "derived-x")


def _raw_points(spark, sf_dir) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n, k = F.col("c_nationkey").cast("string"), F.col("c_custkey") % 6
    raw = F.when(k == 0, n).when(k == 1, F.concat(F.lit("00"), n)).when(k == 2, F.concat(n, F.lit(".0"))).when(k == 3, F.concat(F.lit("  +"), n, F.lit(" "))).when(k == 4, F.lit("   ")).otherwise(F.concat(F.lit(" A"), n))
    return c.select(
        F.col("c_custkey").alias("canonical_id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("name"), raw.alias("io80_code"),
        F.when(F.col("c_custkey") % 2 == 0, raw).alias("io80_map_code"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"),
    )


@query
def sector_normalize(spark, sf_dir):
    return _raw_points(spark, sf_dir).select("canonical_id", sector_id(F.col("io80_code")).alias("sector"))


@query
def classification_column_choice(spark, sf_dir):
    return spark.range(1).select(F.lit(points.classification_column(_raw_points(spark, sf_dir), "io80")).alias("chosen"))


@query
def point_prepare(spark, sf_dir):
    return points.prepare_points(_raw_points(spark, sf_dir), "io80").select("canonical_id", "canonical_name", "type", "x", "y")


@query
def io_transactions_long(spark, sf_dir):
    return derived.io_z(spark, sf_dir)


@query
def io_total_output(spark, sf_dir):
    return derived.io_x(spark, sf_dir)


@query
def io_matrix_wide(spark, sf_dir):
    """A column for each sector."""
    return derived.io_z(spark, sf_dir).groupBy("source").pivot("target", [f"{i:02d}" for i in range(1, 26)]).agg(F.sum("cents"))


@query
def technical_coefficients(spark, sf_dir):
    return io_graph.technical_coefficients(*_economy(spark, sf_dir)).select("source", "target", F.round(F.col("value") * 1e9).cast("long").alias("billionths"))


@query
def io_candidate_edges(spark, sf_dir):
    return io_graph.candidate_edges(_z(spark, sf_dir)).select("source", "target", F.col("value").cast("long").alias("cents"))


@query
def mwas_fast_edges(spark, sf_dir):
    return io_graph.fast_acyclic(_z(spark, sf_dir)).select("source", "target", F.col("value").cast("long").alias("cents"))


@query
def io_weight_audit(spark, sf_dir):
    z = _z(spark, sf_dir)
    a = io_graph.audit(z, io_graph.fast_acyclic(z), "fast")
    return a.select("method", *[F.col(c).cast("long").alias(c) for c in a.columns if c != "method"])


@query
def io_dag_reweighted(spark, sf_dir):
    z, x = _economy(spark, sf_dir)
    z = io_graph.squared(z)
    dag, _ = io_graph.build_dag(spark, z, io_graph.technical_coefficients(z, x))
    return dag.select("source_type", "target_type", F.col("transaction_value").cast("long").alias("cents"), F.round(F.col("technical_coefficient") * 1e9).cast("long").alias("billionths"), "mwas_method")


@query
def acyclicity_check(spark, sf_dir):
    z = _z(spark, sf_dir)
    return spark.createDataFrame([("source", io_graph.is_acyclic(io_graph.candidate_edges(z))), ("kept", io_graph.is_acyclic(io_graph.fast_acyclic(z)))], "graph string, acyclic boolean")


@query
def mwas_exact_objective(spark, sf_dir):
    """Of all sectors, which SQL cannot enumerate."""
    return io_graph.exact_acyclic(spark, _z(spark, sf_dir)).agg(F.coalesce(F.sum("value"), F.lit(0.0)).cast("long").alias("cents"))


# --- roads ---


def _network(spark, sf_dir):
    return roads.build_network(derived.road_lines(spark, sf_dir))


def _snapped(spark, sf_dir):
    """The snapped points are not written: their places are looked up once, and reading the events again is less than writing a wide row for each."""
    vertices, arcs = _network(spark, sf_dir)
    return vertices, arcs, roads.snap(derived.poi(spark, sf_dir), vertices, arcs)


@query
def road_vertices(spark, sf_dir):
    return _network(spark, sf_dir)[0].select("vid", "x", "y")


@query
def road_arcs(spark, sf_dir):
    return _network(spark, sf_dir)[1]


@query
def road_components(spark, sf_dir):
    return _network(spark, sf_dir)[0].groupBy("component").agg(F.count("*").alias("vertices"))


@query
def snap_points(spark, sf_dir):
    return _snapped(spark, sf_dir)[2].select("point_id", "arc_id", F.round("snap_offset", 6).alias("snap_offset"), F.round("snap_distance", 6).alias("snap_distance"))


@query
def distinct_positions(spark, sf_dir):
    places, _ = roads.positions(_snapped(spark, sf_dir)[2])
    return places.select("type", "position", "kind", "a", "b", "off", "weight")


@query
def augment_nodes(spark, sf_dir):
    v, a, s = _snapped(spark, sf_dir)
    return roads.inserted(v, a, s)[0].select("node", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query
def augment_edges(spark, sf_dir):
    v, a, s = _snapped(spark, sf_dir)
    return roads.inserted(v, a, s)[1].select("u", "v", F.round("length", 6).alias("length"), "parent_edge_id")


@query
def sssp_distances(spark, sf_dir):
    return paths.distances(spark.createDataFrame([(0,), (440,)], "source long"), _network(spark, sf_dir)[1]).select("source", "node", "distance")


@query
def sssp_relaxed(spark, sf_dir):
    return paths.relaxed(spark.createDataFrame([(0,), (440,)], "source long"), _network(spark, sf_dir)[1]).select("source", "node", "distance")


def _places(spark, sf_dir):
    v, a, s = _snapped(spark, sf_dir)
    places, of = roads.positions(s)
    return places, of, a


@query
def same_arc_pairs(spark, sf_dir):
    places, _, _ = _places(spark, sf_dir)
    return paths.same_arc_pairs(places, 5.0)


@query
def neighbor_pairs(spark, sf_dir):
    places, _, arcs = _places(spark, sf_dir)
    return paths.neighbor_pairs(places, arcs, RADIUS)


@query
def core_distance(spark, sf_dir):
    places, _, arcs = _places(spark, sf_dir)
    return density.core_distances(places, paths.neighbor_pairs(places, arcs, RADIUS), CONFIG.samples).select("type", "position", "core")


@query
def mutual_reachability(spark, sf_dir):
    places, _, arcs = _places(spark, sf_dir)
    pairs = paths.neighbor_pairs(places, arcs, RADIUS)
    return density.mutual_reachability(pairs, density.core_distances(places, pairs, CONFIG.samples))


@query
def spanning_forest_weight(spark, sf_dir):
    places, _, arcs = _places(spark, sf_dir)
    pairs = paths.neighbor_pairs(places, arcs, RADIUS)
    forest = density.spanning_forest(density.mutual_reachability(pairs, density.core_distances(places, pairs, CONFIG.samples)))
    return forest.groupBy("type").agg(F.count("*").alias("edges"), F.round(F.sum("m"), 6).alias("weight"))


@query
def condensed_tree(spark, sf_dir):
    """Every cluster of the condensed trees at one radius, before some are chosen."""
    places, _, arcs = _places(spark, sf_dir)
    pairs = paths.neighbor_pairs(places, arcs, RADIUS)
    cores = roads.materialize(density.core_distances(places, pairs, CONFIG.samples), "cores")
    found = density.condensed_clusters(cores, density.spanning_forest(density.mutual_reachability(pairs, cores)), CONFIG)
    finite = F.when(F.abs(F.col("stability")) < float("inf"), F.round("stability", 6))
    return found.select("type", "first", "members", F.round("birth", 9).alias("birth"), finite.alias("stability"))


def _clustered(spark, sf_dir):
    v, a, s = _snapped(spark, sf_dir)
    places, _ = roads.positions(s)
    out, summary, trace = density.cluster_by_type(roads.positioned(s, places), places, None, a, CONFIG)
    return v, a, out, summary, trace


@query
def hdbscan_labels(spark, sf_dir):
    return _clustered(spark, sf_dir)[2].select("point_id", "type", "cluster", F.round("membership", 9).alias("membership"))


@query
def clustering_summary(spark, sf_dir):
    return _clustered(spark, sf_dir)[3]


@query
def clustering_trace(spark, sf_dir):
    return _clustered(spark, sf_dir)[4]


# --- clusters given by user, so that SQL can follow: from here to the graph ---


def _given(spark, sf_dir):
    """Every event as a point of one of four clusters for each type, on the network that they are inserted in; those in the corner component are clusters 4 to 7."""
    v, a = _network(spark, sf_dir)
    s = roads.snap(derived.poi(spark, sf_dir, own=F.col("user_id") % 4), v, a)
    s = s.withColumn("cluster", F.col("own") + F.when(F.col("component") == 0, 0).otherwise(4)).drop("own")
    return roads.inserted(v, a, s)


@query
def network_median(spark, sf_dir):
    nodes, edges, p = _given(spark, sf_dir)
    return median.cluster_medians(p, nodes, edges).select("type", "cluster", "center_network_node", F.round("objective", 6).alias("objective"))


@query
def point_median_distance(spark, sf_dir):
    nodes, edges, p = _given(spark, sf_dir)
    return median.median_distances(p, median.cluster_medians(p, nodes, edges), edges).select("point_id", "type", "cluster", F.round("distance_to_cluster_median", 6).alias("distance"))


@query
def voronoi_node_owner(spark, sf_dir):
    nodes, edges, p = _given(spark, sf_dir)
    return paths.nearest_sources(p, edges).select("type", "node", F.round("distance", 6).alias("distance"), "cluster")


@query
def voronoi_cells(spark, sf_dir):
    nodes, edges, p = _given(spark, sf_dir)
    return surface.territories(p, nodes, edges, BOUNDARY, SURFACE)


@query
def partition_area(spark, sf_dir):
    return voronoi_cells(spark, sf_dir).groupBy("type", "cluster").agg(F.round(F.sum("area"), 6).alias("area"))


#: Pairs of types that the queries' graph joins, and their coefficients.
JOINED = [("01", "02", 0.5), ("02", "03", 0.25), ("01", "05", 0.125), ("04", "02", 2.0)]


def _dag(spark) -> DataFrame:
    return spark.createDataFrame(JOINED, "source_type string, target_type string, technical_coefficient double")


def _cells(p: DataFrame) -> DataFrame:
    """The cells that clusters have points in, on two levels: even types on the finer one."""
    level = (F.col("type").cast("int") + 1) % 2
    size = 400 / (F.col("level") + 1)
    return p.withColumn("level", level).select("type", "cluster", "level", F.floor(F.col("x") / size).alias("ix"), F.floor(F.col("y") / size).alias("iy"), F.lit(1.0).alias("area")).distinct()


@query
def overlap_pairs(spark, sf_dir):
    return surface.overlaps(_cells(_given(spark, sf_dir)[2]), _dag(spark))


def _customer_boxes(spark, sf_dir) -> DataFrame:
    """A box for each customer, as a polygon from anyone."""
    k = F.col("c_custkey")
    boxes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.format_string("%02d", F.col("c_nationkey") % 5 + 1).alias("type"), k.cast("long").alias("cluster"), (k * 37 % 1000).cast("double").alias("x0"), ((k * k * 7 + k * 11) % 997).cast("double").alias("y0"),
        (1 + k % 17).cast("double").alias("w"), (1 + k % 13).cast("double").alias("h"),
    )

    def outlines(batches):
        for b in batches:
            g = [polygon_wkb([[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]) for x, y, w, h in zip(*(b.column(c).to_pylist() for c in ("x0", "y0", "w", "h")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("type"), b.column("cluster"), pa.array(g, pa.binary())], names=["type", "cluster", "geometry"])

    return polygons.clean_partitions(boxes.mapInArrow(outlines, "type string, cluster long, geometry binary"))


@query
def polygon_overlap_pairs(spark, sf_dir):
    """Which customers' boxes of joined types share an area."""
    return polygons.polygon_overlaps(_customer_boxes(spark, sf_dir), _dag(spark))


@query
def polygon_union_area(spark, sf_dir):
    """The area that each type's boxes cover together, from parts that are disjoint."""
    return polygons.disjoint_parts(_customer_boxes(spark, sf_dir)).groupBy("type").agg(F.round(F.sum("area"), 6).alias("area"))


@query
def polygon_union_outline(spark, sf_dir):
    """The same from the dissolved outlines, whose rings are traced: their area, and that they are valid."""
    whole = polygons.dissolve(_customer_boxes(spark, sf_dir))
    return polygons.outline_facts(whole).select("type", F.round("area", 6).alias("area"), "valid")


@query
def planar_voronoi_area(spark, sf_dir):
    """Exact Voronoi cells of all suppliers by type, within the box around them."""
    k = F.col("s_suppkey").cast("long")
    sites = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.format_string("%02d", F.col("s_nationkey") % 5 + 1).alias("type"), k.alias("cluster"), k.cast("double").alias("x"), (k * 7919 % 1009).cast("double").alias("y"))
    x1 = sites.agg(F.max("x")).first()[0] + 1
    box = [[[(0.0, -1.0), (x1, -1.0), (x1, 1010.0), (0.0, 1010.0), (0.0, -1.0)]]]
    return planar.planar_territories(sites, sites, box).select("type", "cluster", F.round("area", 6).alias("area"))


def _x_parts(spark, sf_dir):
    nodes, edges, p = _given(spark, sf_dir)
    centers = roads.materialize(median.cluster_medians(p, nodes, edges), "given-centers")
    return xgraph.cluster_graph(centers, _dag(spark), roads.materialize(surface.overlaps(_cells(p), _dag(spark)), "given-overlaps"), edges)


@query
def x_edges(spark, sf_dir):
    return _x_parts(spark, sf_dir)[1].select("source_id", "target_id", "technical_coefficient", "road_distance", "edge_weight")


@query
def disconnected_pairs(spark, sf_dir):
    return _x_parts(spark, sf_dir)[2]


@query
def x_degrees(spark, sf_dir):
    nodes, edges, _ = _x_parts(spark, sf_dir)
    return xgraph.degrees(nodes, edges).select("node_id", "in_degree", "out_degree")


@query
def undirected_projection(spark, sf_dir):
    return xgraph.undirected(_x_parts(spark, sf_dir)[1])


@query
def eigenvector_centrality(spark, sf_dir):
    """Of the economy: sectors as nodes, transactions as weights, a connected graph."""
    z = _z(spark, sf_dir)
    edges = io_graph.candidate_edges(z).select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), (F.col("value") / 1e9).alias("edge_weight"))
    nodes = z.select(F.col("source").alias("node_id")).union(z.select("target")).distinct()
    return xgraph.centrality(nodes, edges).select("node_id", F.round("centrality", 6).alias("centrality"))


@query
def cluster_p90(spark, sf_dir):
    return scoring.cluster_p90(derived.scored_points(spark, sf_dir), "distance").select("type", "cluster", F.round("cluster_distance_p90", 6).alias("p90"))


@query
def tempered_scores(spark, sf_dir):
    p = derived.scored_points(spark, sf_dir)
    c = p.select("type", "cluster", "centrality").distinct()
    return scoring.tempered_scores(p.drop("centrality"), c, 0.15, "distance").select("point_id", "type", "cluster", F.round("normalized_cluster_distance", 9).alias("q"), F.round("score", 9).alias("score"))


@query
def node_ids(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/part.parquet")
    return s.select("p_partkey", node_id(F.col("p_type"), F.col("p_partkey") % 7).alias("node_id"))


@query
def invariant_checks(spark, sf_dir):
    p = derived.scored_points(spark, sf_dir)
    centers = p.select("type", "cluster").distinct().where("type <> '03' or cluster <> 1")
    partitions = p.select("type", "cluster").distinct().where("type <> '04' or cluster <> 2").unionByName(p.where("type = '05' and cluster = 0").select("type", "cluster").distinct())
    return points.cluster_mismatches(p, centers, partitions).select("type", "cluster", "n_centers", "n_partitions")


@query
def engine_scores(spark, sf_dir):
    """The whole workflow: clusters, medians, territories, graph, centrality, scores."""
    from .engine import score_points

    z, x = _economy(spark, sf_dir)
    z = io_graph.squared(z)
    p = derived.towns(spark, sf_dir)
    return score_points(spark, p, derived.road_lines(spark, sf_dir), BOUNDARY, z, io_graph.technical_coefficients(z, x), CONFIG, SURFACE).scores.select(
        "point_id", "type", "cluster", F.round("cluster_centrality", 6).alias("centrality"), F.round("distance_to_cluster_median", 6).alias("distance"), F.round("score", 6).alias("score")
    )


@query
def spatial_summary(spark, sf_dir):
    from .engine import summary_frame

    nodes, edges, _ = _x_parts(spark, sf_dir)
    return summary_frame(xgraph.degrees(nodes, edges), edges)
