"""Contracts of classified points, cluster artifacts and restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sectors import sector_id
from .storage import require


def classification_column(points: DataFrame, classification: str, explicit: str | None = None) -> str:
    """The column that classifies the points: the explicit one, or of io80_code and io80_map_code (or 16) the one with more values.

    Two columns whose values differ in some row are an error, and so is having none."""
    if classification not in ("io16", "io80"):
        raise ValueError("the classification is io16 or io80")
    if explicit:
        if explicit not in points.columns:
            raise ValueError(f"no column {explicit}")
        return explicit
    found = [c for c in (f"{classification}_code", f"{classification}_map_code") if c in points.columns]
    if not found:
        raise ValueError(f"no column for {classification}")
    if len(found) == 1:
        return found[0]
    a, b = (sector_id(F.col(c)) for c in found)
    conflicts, n_a, n_b = points.agg(F.count_if(a.isNotNull() & b.isNotNull() & (a != b)), F.count(a), F.count(b)).first()
    if conflicts:
        raise ValueError(f"{conflicts} rows in which {found[0]} and {found[1]} differ")
    return found[0] if n_a >= n_b else found[1]


def display_name(points: DataFrame) -> DataFrame:
    """canonical_name from itself, name or the id, the first that isn't blank."""
    have = [c for c in ("canonical_name", "name") if c in points.columns][:1]
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return points.withColumn("canonical_name", F.coalesce(*[text(c) for c in have], F.col("canonical_id").cast("string")))


def prepare_points(points: DataFrame, classification: str, explicit: str | None = None) -> DataFrame:
    """canonical_id (unique, not blank), canonical_name, type, x, y and other columns; unclassified points are left out."""
    for c in ("canonical_id", "x", "y"):
        if c not in points.columns:
            raise ValueError(f"no column {c}")
    column = classification_column(points, classification, explicit)
    out = display_name(points).withColumn("type", sector_id(F.col(column))).where(F.col("type").isNotNull()).withColumn("canonical_id", F.col("canonical_id").cast("string"))
    require(out.where("x is null or y is null or isnan(x) or isnan(y)").select("canonical_id"), "points without coordinates")
    require(out.where("canonical_id is null or trim(canonical_id) = ''").select("type"), "points without an id")
    require(out.groupBy("canonical_id").count().where("count > 1"), "repeated point ids")
    if out.isEmpty():
        raise ValueError("no classified points")
    return out


def normal_type(df: DataFrame) -> DataFrame:
    out = df.withColumn("type", sector_id(F.col("type")))
    require(out.where("type is null").limit(1), "rows without a type")
    return out


def check_types(points: DataFrame, z: DataFrame) -> None:
    """Every type of the points is a sector of the transactions."""
    require(points.select("type").distinct().join(z.select(F.col("source").alias("type")), "type", "left_anti").orderBy("type"), "types without transactions", 20)


def retained(points: DataFrame) -> DataFrame:
    return points.where("cluster >= 0")


def check_snaps(points: DataFrame, most: float | None) -> None:
    if most is not None:
        n = points.where(F.col("snap_distance") > most).count()
        if n:
            raise ValueError(f"{n} points are farther than {most} from a road")


def cluster_mismatches(points: DataFrame, centers: DataFrame, partitions: DataFrame) -> DataFrame:
    """type, cluster, n_points, n_centers, n_partitions of keys that aren't in all three, or that centers or partitions have more than once."""
    count = lambda df, name: df.groupBy("type", "cluster").agg(F.count("*").alias(name))
    both = count(points, "n_points").join(count(centers, "n_centers"), ["type", "cluster"], "full").join(count(partitions, "n_partitions"), ["type", "cluster"], "full")
    return both.na.fill(0).where("n_points = 0 or n_centers <> 1 or n_partitions <> 1")


def check_clusters(points: DataFrame, centers: DataFrame, partitions: DataFrame) -> int:
    require(cluster_mismatches(points, centers, partitions), "clusters differ between points, centers and partitions")
    return centers.count()


def restart_points(points: DataFrame) -> DataFrame:
    """point_id, type, cluster, distance_to_cluster_median and names, also from artifacts that use the older distance column; those
    must say that all their distances are road distances."""
    if "distance_to_cluster_median" not in points.columns:
        if "network_distance_to_center" not in points.columns or "point_center_distance_method" not in points.columns:
            raise ValueError("no distance to the cluster's median")
        require(points.where("not point_center_distance_method <=> 'network_shortest_path'").select("type", "cluster"), "distances that are not road distances")
        points = points.withColumn("distance_to_cluster_median", F.col("network_distance_to_center"))
    if "point_id" not in points.columns:
        points = points.withColumn("point_id", F.col("canonical_id"))
    out = normal_type(points).withColumn("point_id", F.col("point_id").cast("string")).withColumn("cluster", F.col("cluster").cast("long"))
    d = "distance_to_cluster_median"
    require(out.where(f"{d} is null or isnan({d}) or {d} < 0 or {d} = double('Infinity')").select("point_id"), "distances must be finite and not negative")
    require(out.where("point_id is null or trim(point_id) = ''").select("type"), "points without an id")
    require(out.groupBy("point_id").count().where("count > 1"), "repeated point ids")
    return out


def align_restart(points: DataFrame, centers: DataFrame, partitions: DataFrame) -> tuple[DataFrame, int]:
    """Points of clusters that have a center, and how many rows that leaves out; clusters without points or partitions are an error."""
    keys = ["type", "cluster"]
    kept = points.join(centers.select(*keys).distinct(), keys, "left_semi")
    require(centers.select(*keys).join(kept.select(*keys), keys, "left_anti"), "centers without points")
    require(centers.select(*keys).join(partitions.select(*keys), keys, "left_anti"), "centers without partitions")
    return kept, points.count() - kept.count()


def clean_centers(centers: DataFrame) -> DataFrame:
    out = normal_type(centers).withColumn("cluster", F.col("cluster").cast("long"))
    require(out.where("cluster < 0 or cluster is null or x is null or y is null or isnan(x) or isnan(y)").select("type", "cluster"), "centers must have a cluster and coordinates")
    require(out.groupBy("type", "cluster").count().where("count > 1"), "repeated centers")
    return out.select("type", "cluster", "center_network_node", "x", "y").orderBy("type", "cluster")
