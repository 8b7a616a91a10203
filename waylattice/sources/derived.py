"""Inputs derived from the star-schema tables, in integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import materialize


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sector(nation) -> F.Column:
    return F.format_string("%02d", nation + 1)


def io_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, cents: sales of suppliers' nations to customers' nations."""
    line = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    order = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    buyer = order.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")  # so that order lines move once
    joined = line.join(buyer, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(_sector(F.col("s_nationkey")).alias("source"), _sector(F.col("c_nationkey")).alias("target")).agg(F.sum("cents").alias("cents"))


def io_x(spark: SparkSession, sf_dir: str, z: DataFrame | None = None) -> DataFrame:
    """sector, cents: gross output, above intermediate use."""
    z = io_z(spark, sf_dir) if z is None else z
    use = z.groupBy(F.col("target").alias("sector")).agg(F.sum("cents").alias("used"))
    c = _read(spark, sf_dir, "customer")
    final = c.groupBy(_sector(F.col("c_nationkey")).alias("sector")).agg(F.sum(F.greatest(F.round(F.col("c_acctbal") * 100), F.lit(0.0)).cast("long")).alias("final"))
    nations = _read(spark, sf_dir, "nation").select(_sector(F.col("n_nationkey")).alias("sector"))
    return nations.join(use, "sector", "left").join(final, "sector", "left").select("sector", (F.coalesce("used", F.lit(0)) + F.coalesce("final", F.lit(0)) + 100).alias("cents"))


#: The lattice of the derived road network: points on a side, their distance, and the corner that is a component of its own.
SIDE, SPACING, CORNER = 21, 50, 17


def road_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, len: arcs of the lattice, u < v, by lattice number i * 21 + j. An arc is there if some order line has its number."""
    key = _read(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % (2 * SIDE * SIDE)).alias("k")).distinct()
    key = materialize(key, "lattice-numbers")  # some hundreds; the order lines are read once, and no later step is pushed down to each of them
    cells = key.select(F.expr(f"cast(k div 2 div {SIDE} as long)").alias("i"), F.expr(f"cast(k div 2 as long) % {SIDE}").alias("j"), (F.col("k") % 2).alias("h"))
    arcs = cells.withColumn("i2", F.col("i") + F.col("h")).withColumn("j2", F.col("j") + 1 - F.col("h"))
    arcs = arcs.where((F.col("i2") < SIDE) & (F.col("j2") < SIDE)).where((F.col("i") * 7 + F.col("j") * 3 + F.col("h") * 5) % 11 != 0)
    corner = lambda i, j: (F.col(i) >= CORNER) & (F.col(j) >= CORNER)
    arcs = arcs.where(corner("i", "j") == corner("i2", "j2"))
    return arcs.select((F.col("i") * SIDE + F.col("j")).alias("u"), (F.col("i2") * SIDE + F.col("j2")).alias("v"), F.lit(float(SPACING)).alias("len"))


def road_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, part, coords: the lattice as lines, every seventh also reversed, as road files have them."""
    arcs = road_lattice(spark, sf_dir)
    point = lambda c: F.struct((F.expr(f"cast({c} div {SIDE} as double)") * SPACING).alias("x"), ((F.col(c) % SIDE).cast("double") * SPACING).alias("y"))
    lines = arcs.select((F.col("u") * 2 + (F.col("v") > F.col("u") + 1).cast("long")).alias("line_id"), F.lit(0).alias("part"), F.array(point("u"), point("v")).alias("coords"))
    again = lines.where("line_id % 7 = 0").select((F.col("line_id") + 10_000).alias("line_id"), "part", F.reverse("coords").alias("coords"))
    return lines.unionByName(again)


def poi(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    """point_id, type, x, y: from events; the type is the rank of the event type. more: further columns, of event_id and user_id."""
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    names = materialize(e.select("event_type").distinct(), "event-types")  # a handful; each use of the points would look for them in all events
    kinds = names.agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    k = F.array_position("kinds", F.col("event_type")).cast("long")
    x = ((F.col("user_id") * 37 + k * 3) % 20) * 50 + (F.col("event_id") * 13) % 7
    y = ((F.col("user_id") * 53 + k * 5) % 20) * 50 + (F.col("event_id") * 29) % 7
    return e.join(F.broadcast(kinds)).select(F.col("event_id").cast("string").alias("point_id"), F.format_string("%02d", k).alias("type"), x.cast("double").alias("x"), y.cast("double").alias("y"), *[c.alias(n) for n, c in more.items()])


def towns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, type, x, y: two towns for each type, 49 places each, a point for every event."""
    e = poi(spark, sf_dir, event_id=F.col("event_id"), town=F.col("user_id") % 2)
    x = 105 + F.col("town") * 600 + (F.col("event_id") * 13) % 7 * 3
    y = 150 + F.col("town") * 500 + F.expr("event_id div 7") % 7 * 2
    return e.select("point_id", "type", x.cast("double").alias("x"), y.cast("double").alias("y"))


def scored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, type, cluster, distance, centrality: isolates the scoring."""
    p = poi(spark, sf_dir, cluster=F.col("user_id") % 4, distance=(F.col("event_id") % 997).cast("double"))
    return p.drop("x", "y").withColumn("centrality", (1 + F.col("cluster")).cast("double"))


#: The boundary of the derived surface: x and y from, x and y to, and the cells' side.
BOUNDARY, RESOLUTION = (0.0, 0.0, 1000.0, 1000.0), 50.0
