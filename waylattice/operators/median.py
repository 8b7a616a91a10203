"""Exact network medians of clusters, and the distance of each point to its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .paths import broadcast_graph, pair_distances, relaxed
from .storage import materialize, require, small


#: Added to bounds of distances, by which rounding can't lose a node.
RELATIVE, ABSOLUTE = 1e-9, 1e-9


def _sums(demand: DataFrame, edges: DataFrame, shared) -> DataFrame:
    """type, cluster, node, objective, reached: weighted distance sums from all demand to the nodes within `bound` of the hub, and the
    demand that reaches them. Where a worker can hold the graph, each task adds up the demand of a cluster that it has, so demand
    by node rows never exist."""
    far = (F.col("from_hub") + F.col("bound")) * (1 + RELATIVE) + ABSOLUTE
    if shared is None:
        d = relaxed(demand.select(F.col("node").alias("source"), far.alias("cutoff")), edges)
        hubs = demand.select("type", "cluster", "hub", "bound").distinct()
        near = relaxed(hubs.select(F.col("hub").alias("source"), F.col("bound").alias("cutoff")), edges).select(F.col("source").alias("hub"), "node", F.col("distance").alias("off"))
        near = hubs.join(near, "hub").where("off <= bound").select("type", "cluster", "node")
        each = demand.select("type", "cluster", F.col("node").alias("source"), "w", far.alias("far")).join(d, "source").where("distance <= far").join(near, ["type", "cluster", "node"])
        return each.groupBy("type", "cluster", "node").agg(F.sum(F.col("w") * F.col("distance")).alias("objective"), F.sum("w").alias("reached"))
    schema = StructType([StructField("type", StringType()), StructField("cluster", LongType()), StructField("node", LongType()), StructField("objective", DoubleType()), StructField("reached", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        key, total, reached = None, {}, {}

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(total)), pa.array(np.full(len(total), key[1])), pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.float64()), pa.array(list(reached.values()), pa.int64())], names=schema.names
            )

        for b in batches:
            for t, c, node, w, hub, bound, cutoff in zip(*[b.column(x).to_pylist() for x in ("type", "cluster", "node", "w", "hub", "bound", "far")], strict=True):
                if (t, c) != key:
                    if key:
                        yield out()
                    key, total = (t, c), dict.fromkeys(graph.distances(hub, bound)[0], 0.0)
                    reached = dict.fromkeys(total, 0)
                for v, d in graph.distances(node, cutoff)[0].items():
                    if v in total:
                        total[v] += w * d
                        reached[v] += w
        if key:
            yield out()

    placed = demand.withColumn("far", far).repartition("type", "cluster", F.pmod(F.xxhash64("node"), F.lit(16)))
    parts = placed.sortWithinPartitions("type", "cluster", "node").mapInArrow(run, schema)
    return parts.groupBy("type", "cluster", "node").agg(F.sum("objective").alias("objective"), F.sum("reached").alias("reached"))


def cluster_medians(points: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """type, cluster, center_network_node, objective, x, y of points (type, cluster, node): the node with the smallest sum of road
    distances to all points of the cluster; of nodes within max(1e-9, 1e-12 * sum) of it, the smallest. Any node is a candidate.
    Points of one cluster in different components are an error.

    One node of each cluster, its hub, is solved first. By the triangle inequality the median is at most twice the hub's sum,
    divided by the number of points, away from it; so only nodes within that bound are summed, and searches from a point end
    at its distance to the hub plus the bound. What a cluster costs grows with its reach, not with the network."""
    keys, shared = ["type", "cluster"], broadcast_graph(edges)
    demand = materialize(points.groupBy("type", "cluster", "node").agg(F.count("*").alias("w")), "demand")
    size = materialize(demand.groupBy(*keys).agg(F.sum("w").alias("size"), F.min("node").alias("hub")), "hubs")
    demand = demand.join(size, keys)
    to_hub = pair_distances(demand.select(F.col("hub").alias("source"), F.col("node").alias("target")), edges, shared).toDF("hub", "node", "from_hub")
    demand = materialize(demand.join(to_hub, ["hub", "node"], "left"), "demand-from-hub")
    require(demand.where("from_hub is null").select(*keys).distinct(), "clusters that no node reaches as a whole")
    bound = (2 * F.sum(F.col("w") * F.col("from_hub")) / F.first("size")) * (1 + RELATIVE) + ABSOLUTE
    demand = demand.join(demand.groupBy(*keys).agg(bound.alias("bound")), keys)
    sums = materialize(_sums(demand, edges, shared).join(size.drop("hub"), keys).where("reached = size"), "median-sums")
    best = sums.groupBy("type", "cluster").agg(F.min("objective").alias("best"))
    slack = F.greatest(F.lit(1e-9), 1e-12 * F.abs("best"))
    tied = sums.join(best, ["type", "cluster"]).where(F.col("objective") <= F.col("best") + slack)
    chosen = tied.groupBy("type", "cluster").agg(F.min(F.struct("node", "objective")).alias("m")).select("type", "cluster", F.col("m.node").alias("center_network_node"), F.col("m.objective").alias("objective"))
    return chosen.join(nodes.select(F.col("node").alias("center_network_node"), "x", "y"), "center_network_node").select("type", "cluster", "center_network_node", "objective", "x", "y")


def median_distances(points: DataFrame, centers: DataFrame, edges: DataFrame) -> DataFrame:
    """points with distance_to_cluster_median and its method; a point without a center or a road to it is an error."""
    keys = ["type", "cluster"]
    sources = materialize(centers.select(*keys, F.col("center_network_node").alias("source")), "center-nodes")
    require(points.join(small(sources), keys, "left_anti").select("point_id", *keys), "points of clusters without a center")
    asked = points.join(small(sources), keys)
    d = pair_distances(asked.select("source", F.col("node").alias("target")), edges).toDF("source", "node", "distance_to_cluster_median")
    out = asked.join(small(materialize(d, "center-distances")), ["source", "node"], "left")
    out = materialize(out.withColumn("point_center_distance_method", F.lit("network_shortest_path")).drop("source"), "median-distances")
    require(out.where("distance_to_cluster_median is null").select("point_id", *keys), "points without a road to their center")
    return out


def centroid_nodes(points: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """type, cluster, center_network_node, x, y by the mean of the points' coordinates: the nearer end of the nearest edge."""
    from .roads import near_arcs

    mean = points.groupBy("type", "cluster").agg(F.avg("x").alias("px"), F.avg("y").alias("py")).withColumn("id", F.concat_ws("\u0000", "type", F.col("cluster").cast("string")))
    a = nodes.select(F.col("node").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nodes.select(F.col("node").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = near_arcs(mean.select("id", "px", "py"), edges.join(a, "u").join(b, "v"))
    first = near.groupBy("id").agg(F.min(F.struct("aug_edge_id", "t", "u", "v")).alias("e")).select("id", F.when(F.col("e.t") <= 0.5, F.col("e.u")).otherwise(F.col("e.v")).alias("node"))
    return mean.join(first, "id").join(nodes.select("node", "x", "y"), "node").select("type", "cluster", F.col("node").alias("center_network_node"), "x", "y")


def medians_or_centroids(points: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """As cluster_medians, with center_method. A cluster whose points roads don't join has no median: its center is the end of a road that is near the mean of its
    points, with a null objective."""
    keys = ["type", "cluster"]
    apart = points.join(nodes.select("node", "component"), "node").groupBy(*keys).agg(F.count_distinct("component").alias("n")).where("n > 1").select(*keys)
    apart = materialize(apart, "apart-clusters")
    whole = cluster_medians(points.join(apart, keys, "left_anti"), nodes, edges).withColumn("center_method", F.lit("network_1_median"))
    rest = centroid_nodes(points.join(apart, keys, "left_semi"), nodes, edges) if not apart.isEmpty() else None
    if rest is None:
        return whole
    return whole.unionByName(rest.select(*keys, "center_network_node", F.lit(None).cast("double").alias("objective"), "x", "y", F.lit("euclidean_centroid_road_snap_fallback").alias("center_method")))
