"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, materialize, table


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """source, source_size, target (double): shares of the sum of all sizes by weight, none above max_repeats its size.

    The weights repeat over the sources in code point order, null last. The water level is the first at which no source
    above it is full: sources fill in the order of capacity by weight. One row per source, so its windows are small.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("r", F.col("source").asc_nulls_last())
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("w", weight.cast("long")).withColumn("r", (max_repeats * F.col("source_size")).cast("double") / F.col("w"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("pos", F.row_number().over(fill))
    s = s.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(max_repeats * F.col("source_size")).over(before), F.lit(0))).cast("double")
        / F.sum("w").over(after),
    )
    s = s.withColumn("open_from", F.min(F.when(F.col("level") <= F.col("r"), F.col("pos"))).over(everything))
    s = s.withColumn("open_level", F.max(F.when(F.col("pos") == F.col("open_from"), F.col("level"))).over(everything))
    full = F.col("open_from").isNull() | (F.col("pos") < F.col("open_from"))
    return s.select("source", "source_size", F.when(full, (max_repeats * F.col("source_size")).cast("double")).otherwise(F.col("open_level") * F.col("w")).alias("target"))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Take documents so that the words of each source come near its target; the budget is the number of all words.

    Returns one row per input row: id_col, source, size, source_size, target, taken.

    Documents are shuffled by the MD5 of their id. The e-th copy of a document finishes at the virtual time (e * source
    size + sizes of its source up to it) / target. All copies are ordered by it and taken up to the budget; the copy that
    crosses it gives the words still missing. Sums over a source or over all copies are made in two levels, of slices of
    the shuffled source and of ranges of virtual time, so no task holds a source, and only the range that the budget
    falls in is sorted. Both numbers grow with the square root or the number of documents.

    * A null text has size 0, and so takes nothing. A null source is a source of its own, the last; a null id hashes as
      empty text.
    * Ties of virtual time go by source, hash, id and size; rows alike in all of them are interchangeable.
    * An empty table gives an empty result; a source without words has target 0.
    """
    sized = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(NOT_SPACE)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
        ),
        "mixing-sizes",
    )
    n = sized.count()
    slices = max(256, math.ceil(n / 20_000))
    ranges = max(4096, math.isqrt(n))
    targets = source_targets(sized, weights, max_repeats)

    sliced = sized.withColumn("slice", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * slices / F.lit(1 << 32)).cast("int"))
    starts = _starts(sliced, targets)
    within = Window.partitionBy("source", "slice").orderBy("key", F.col("id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = materialize(
        sliced.withColumn("upto", F.sum("size").over(within))
        .join(starts.withColumnsRenamed({"source": "source_", "slice": "slice_"}), (F.col("source").eqNullSafe(F.col("source_"))) & (F.col("slice") == F.col("slice_")))
        .select("id", "source", "size", "key", "source_size", "target", (F.col("start") + F.col("upto")).alias("upto")),
        "mixing-queue",
        n,
    )
    finish = lambda e: (e * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")
    copies = (
        queued.where("size > 0 and target > 0")
        .withColumn("copy", F.explode(F.array(*[F.lit(e).cast("long") for e in range(max_repeats)])))
        .withColumn("finish", finish(F.col("copy")))
        .withColumn("range", F.least(F.floor(F.col("finish") * ranges), F.lit(2 * ranges)).cast("long"))
    )
    by_range = copies.groupBy("range").agg(F.sum("size").alias("words"))
    budget = queued.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    upto = by_range.select("range", "words", F.sum("words").over(Window.orderBy("range")).alias("upto"))
    crossing = upto.where(F.col("upto") >= budget).orderBy("range").first()
    if crossing is None:  # no words at all
        return queued.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    order = lambda e: F.struct(e.alias("a"), F.col("source").isNull().alias("b"), F.coalesce("source", F.lit("")).alias("c"), F.col("key").alias("d"), F.coalesce(F.col("id").cast("string"), F.lit("0")).alias("e"), F.col("size").alias("f"))
    cut = (
        copies.where(F.col("range") == crossing["range"])
        .withColumn("order", order(F.col("finish")))
        .withColumn("sum", F.sum("size").over(Window.orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + (crossing["upto"] - crossing["words"]))
        .where(F.col("sum") >= budget)
        .orderBy("order")
        .select("finish", "source", "key", "id", "size", "order", (F.lit(budget) - F.col("sum") + F.col("size")).alias("rest"))
        .first()
    )
    last = F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip("abcdef", cut["order"], ("double", "boolean", "string", "string", "string", "long"), strict=True)])
    took = lambda e: F.when(order(finish(e)) < last, F.col("size")).when(order(finish(e)) == last, F.lit(cut["rest"])).otherwise(F.lit(0))
    taken = sum((took(e) for e in range(1, max_repeats)), took(0))
    return queued.select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(F.lit(0)).cast("long").alias("taken")
    )


def _starts(sliced: DataFrame, targets: DataFrame) -> DataFrame:
    """source, slice, words before the slice in its source, source_size, target."""
    t = targets.withColumnRenamed("source", "source_")
    return (
        sliced.groupBy("source", "slice")
        .agg(F.sum("size").alias("words"))
        .select("source", "slice", (F.sum("words").over(Window.partitionBy("source").orderBy("slice")) - F.col("words")).alias("start"))
        .join(t, F.col("source").eqNullSafe(F.col("source_")))
        .drop("source_")
    )


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM s),
r AS (SELECT *, (3 * source_size)::DOUBLE / w AS r FROM w),
p AS (SELECT *, row_number() OVER f AS pos,
        (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY r, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(w) OVER (ORDER BY r, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM r WINDOW f AS (ORDER BY r, source ASC NULLS LAST)),
o AS (SELECT *, min(CASE WHEN level <= r THEN pos END) OVER () AS open_from FROM p),
l AS (SELECT *, max(CASE WHEN pos = open_from THEN level END) OVER () AS open_level FROM o),
t AS (SELECT source, source_size, CASE WHEN open_from IS NULL OR pos < open_from THEN (3 * source_size)::DOUBLE ELSE open_level * w END AS target FROM l),
q AS (SELECT d.*, t.source_size, t.target, row_number() OVER () AS row_id,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, e, (e * source_size + upto)::DOUBLE / target AS finish
      FROM q, (VALUES (0), (1), (2)) x(e) WHERE size > 0 AND target > 0),
g AS (SELECT row_id, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS total FROM c),
k AS (SELECT row_id, sum(greatest(0, least(size, (SELECT sum(size) FROM sized) - total + size))) AS taken FROM g GROUP BY row_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN k USING (row_id)
"""
