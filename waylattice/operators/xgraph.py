"""The graph of clusters: joined by the economy and by overlap, weighed by coefficient and road distance, and its centrality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sectors import node_id
from .io_graph import is_acyclic
from .paths import paths_to
from .storage import materialize, require

#: Edges of the projection that are iterated in one place; more are iterated as tables.
LOCAL_EDGES = 500_000


def cluster_graph(centers: DataFrame, dag: DataFrame, overlap: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and disconnected pairs.

    Every center is a node. A pair of clusters that overlap, and whose types the graph of sectors joins, is an edge if roads
    join their medians: technical_coefficient * road_distance is its weight, 0 if both medians are one node. Else the pair is
    reported. Clusters with a common median node are solved once."""
    keys = ["type", "cluster"]
    require(centers.groupBy(*keys).count().where("count > 1"), "repeated centers")
    if not is_acyclic(dag, "source_type", "target_type"):
        raise ValueError("the graph of sectors has a cycle")
    end = lambda side, node: centers.select(F.col("type").alias(f"{side}_type"), F.col("cluster").alias(f"{side}_cluster"), F.col("center_network_node").alias(node))
    for side in ("source", "target"):
        require(overlap.join(end(side, "n"), [f"{side}_type", f"{side}_cluster"], "left_anti").select(f"{side}_type", f"{side}_cluster"), "territories without a center")
    pairs = overlap.join(end("source", "source"), ["source_type", "source_cluster"]).join(end("target", "target"), ["target_type", "target_cluster"])
    pairs = pairs.join(dag.select("source_type", "target_type", "technical_coefficient"), ["source_type", "target_type"])
    solved = materialize(paths_to(pairs, edges), "x-paths")
    found = materialize(pairs.join(solved, ["source", "target"]), "x-pairs")
    x_edges = found.where("distance is not null").select(
        node_id(F.col("source_type"), F.col("source_cluster")).alias("source_id"), node_id(F.col("target_type"), F.col("target_cluster")).alias("target_id"),
        "source_type", "source_cluster", "target_type", "target_cluster", "technical_coefficient", F.col("distance").alias("road_distance"),
        (F.col("technical_coefficient") * F.col("distance")).alias("edge_weight"), F.col("path").alias("road_path"),
    )
    apart = found.where("distance is null").select("source_type", "source_cluster", "target_type", "target_cluster", F.lit("disconnected_centers").alias("reason"))
    x_nodes = centers.select(node_id(F.col("type"), F.col("cluster")).alias("node_id"), "type", "cluster", "center_network_node", "x", "y")
    return x_nodes, x_edges, apart


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with in_degree and out_degree."""
    n_in = edges.groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("in_degree"))
    n_out = edges.groupBy(F.col("source_id").alias("node_id")).agg(F.count("*").alias("out_degree"))
    return nodes.join(n_in, "node_id", "left").join(n_out, "node_id", "left").na.fill(0, ["in_degree", "out_degree"])


def undirected(edges: DataFrame) -> DataFrame:
    """a < b, weight: positive weights without their direction, added up for both directions."""
    return edges.where("edge_weight > 0").groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.sum("edge_weight").alias("weight"))


def centrality(nodes: DataFrame, edges: DataFrame, rounds: int = 5000, tolerance: float = 1e-10, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node_id, centrality: weighted eigenvector centrality of the undirected projection, of unit length.

    From equal values x <- x + W x, scaled to length 1, until the sum of changes is below nodes * tolerance; an error if it
    isn't after `rounds`. Without edges all nodes are equal. A projection of few edges is iterated in arrays, a larger one as
    tables, one join and one sum a round."""
    names = nodes.select("node_id").distinct()
    n = names.count()
    if not n:
        return names.withColumn("centrality", F.lit(0.0))
    pairs = materialize(undirected(edges), "undirected")
    m = pairs.count()
    if not m:
        return names.withColumn("centrality", F.lit(1 / float(np.sqrt(n))))
    spark = nodes.sparkSession
    if m <= local_edges and n <= local_edges:
        ids = sorted(r[0] for r in names.collect())
        at = {x: i for i, x in enumerate(ids)}
        rows = sorted(pairs.collect())
        a, b, w = np.array([at[r["a"]] for r in rows]), np.array([at[r["b"]] for r in rows]), np.array([r["weight"] for r in rows])
        x = np.full(n, 1 / n)
        for _ in range(rounds):
            y = x + np.bincount(a, w * x[b], n) + np.bincount(b, w * x[a], n)
            y /= np.sqrt((y * y).sum())
            if np.abs(y - x).sum() < n * tolerance:
                return spark.createDataFrame(list(zip(ids, y.tolist(), strict=True)), "node_id string, centrality double")
            x = y
        raise RuntimeError(f"centrality has not converged after {rounds} rounds")
    arcs = materialize(pairs.select("a", "b", "weight").union(pairs.select("b", "a", "weight")).toDF("node_id", "to", "weight"), "x-arcs")
    x = materialize(names.withColumn("v", F.lit(1 / n)), "centrality")
    for _ in range(rounds):
        flow = x.join(arcs, "node_id").groupBy(F.col("to").alias("node_id")).agg(F.sum(F.col("v") * F.col("weight")).alias("flow"))
        y = materialize(x.join(flow, "node_id", "left").select("node_id", "v", (F.col("v") + F.coalesce("flow", F.lit(0.0))).alias("y")), "centrality")
        length = float(np.sqrt(y.agg(F.sum(F.col("y") * F.col("y"))).first()[0]))
        change = y.agg(F.sum(F.abs(F.col("y") / length - F.col("v")))).first()[0]
        x = y.select("node_id", (F.col("y") / length).alias("v"))
        if change < n * tolerance:
            return x.withColumnRenamed("v", "centrality")
    raise RuntimeError(f"centrality has not converged after {rounds} rounds")


def check_direction(direction: str) -> str:
    """incoming and outgoing are accepted, and change nothing: the projection has no direction."""
    if direction not in ("incoming", "outgoing"):
        raise ValueError("the direction is incoming or outgoing")
    return "undirected"
