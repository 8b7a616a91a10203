"""Bounded point scores, tempered by distance to the own cluster's median."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, require, small


def cluster_p90(points: DataFrame, distance: str = "distance_to_cluster_median") -> DataFrame:
    """type, cluster, cluster_distance_p90 (exact, with linear interpolation). Equal distances are counted together before they
    shuffle, so a cluster that holds most rows is no more than its different distances."""
    counts = points.groupBy("type", "cluster", F.col(distance).alias("d")).agg(F.count("*").alias("n"))
    return counts.groupBy("type", "cluster").agg(F.expr("percentile(d, 0.9, n)").alias("cluster_distance_p90"))


def tempered_scores(points: DataFrame, centrality: DataFrame, tempering: float = 0.15, distance: str = "distance_to_cluster_median") -> DataFrame:
    """Adds cluster_centrality, cluster_distance_p90, normalized_cluster_distance, distance_tempering and score to points.

    The distance is taken as a part of the cluster's 90th percentile (1 at least), at most 1, and lowers the centrality by
    at most the tempering. centrality: type, cluster, centrality. A point whose cluster has none is an error."""
    if not 0 <= tempering < 1:
        raise ValueError("tempering must be at least 0 and below 1")
    clusters = materialize(cluster_p90(points, distance), "cluster-p90")
    require(clusters.join(centrality, ["type", "cluster"], "left_anti").select("type", "cluster"), "points of clusters without centrality")
    clusters = small(materialize(clusters.join(centrality.select("type", "cluster", F.col("centrality").alias("cluster_centrality")), ["type", "cluster"]), "cluster-scores"))
    q = F.least(F.col(distance) / F.greatest("cluster_distance_p90", F.lit(1.0)), F.lit(1.0))
    return (
        points.join(clusters, ["type", "cluster"])
        .withColumn("normalized_cluster_distance", q)
        .withColumn("distance_tempering", F.lit(float(tempering)))
        .withColumn("score", F.col("cluster_centrality") * (1 - F.lit(float(tempering)) * F.col("normalized_cluster_distance")))
    )


def check_bounds(scores: DataFrame) -> None:
    c, low = F.col("cluster_centrality"), F.col("cluster_centrality") * (1 - F.col("distance_tempering"))
    slack = F.greatest(F.lit(1e-12), F.abs(c) * 1e-12)
    require(scores.where((F.col("score") < low - slack) | (F.col("score") > c + slack)).select("type", "cluster", "score"), "scores outside their bounds")
