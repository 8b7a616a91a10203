"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """node, label (the smallest node reachable) for every node of links (u, v); links may repeat, in either direction.

    Every round hangs the neighbours of a node on its smallest neighbour, first the larger ones, then the smaller ones,
    until nothing changes; the number of rounds grows with the logarithm of the longest path. Only minima are
    aggregated, so no task or driver holds a component. Null nodes are not allowed; an empty table gives an empty one. rows: how many links there are at most, if known.
    """
    e = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", rows)
    n = e.count()  # edges never grow in number
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.withColumnRenamed("m", "v"))
        e = materialize(small.distinct(), "links", n)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        state = now
