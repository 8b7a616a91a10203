"""Exact dedup in DataFrame operations only: 128-bit content hash, smallest stable id, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, free_names, materialize, native_filter, table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group rows whose texts are equal after each run of whitespace becomes one blank.

    Returns one row per input row: id_col, keep_id, group_size, kept, text_sha256. Other input columns are not read.

    * Rows are grouped by the 128-bit hash first; this shuffles ids and hashes alone. The texts of groups of two or more,
      picked by a filter of bounded size, are then grouped by their bytes, so a collision splits such a group. Both aggregations combine before they
      shuffle, and the joins are inner or left, so that a group of any size is combined or split.
    * A null text counts as empty. A null id never is the smallest, unless all ids of its group are null; then keep_id is
      null and those rows are kept.
    * Rows with the same id and equal texts are each counted, and each kept if that id is the smallest.
    * An empty table gives an empty result.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    hashed = materialize(rows.select("id", F.unhex(F.md5("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("s")), "dedup-hashes")

    # a table of its own: the join below then has an exchange on either side, and its hot partitions can be split
    n = hashed.count()
    several = materialize(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "dedup-groups", n)
    # only texts that may be in a group are shuffled
    grouped = native_filter(several.select(F.xxhash64("h").alias("key")), several.count())
    texts = (
        rows.withColumn("h", F.unhex(F.md5("norm")))
        .where(grouped(F.xxhash64("h")))
        .join(several, "h")
        .groupBy("norm")  # the bytes
        .agg(F.min("id").alias("keep"), F.count("*").alias("n"))
        .select(F.unhex(F.md5("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("s"), "keep", "n")
    )
    return hashed.join(texts, ["h", "s"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("n").isNull(), True).otherwise(F.col("id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.lower(F.hex("s")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that exact_dedup keeps; of rows that repeat id and text, one. Columns may have any
    names."""
    found = exact_dedup(docs, id_col, text_col)
    key = lambda id_, sha: F.xxhash64(id_, sha)
    several = found.where("group_size > 1").select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"), "kept")
    several = materialize(several.groupBy("id", "sha").agg(F.max("kept").alias("kept")), "dedup-verdicts")
    in_group = native_filter(several.select(key("id", "sha").alias("key")), several.count())
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " "), 256)
    own, other_id, other_sha, verdict = free_names(docs, "text_sha", "verdict_id", "verdict_sha", "verdict")
    rows = docs.withColumn(own, sha)
    # most rows have no copy, and stay where they are
    single = rows.where(~in_group(key(F.col(id_col), F.col(own))))
    judged = rows.where(in_group(key(F.col(id_col), F.col(own)))).join(several.toDF(other_id, other_sha, verdict), F.col(id_col).eqNullSafe(F.col(other_id)) & (F.col(own) == F.col(other_sha)), "left")
    judged = judged.where(F.col(verdict).isNull() | F.col(verdict)).dropDuplicates([id_col, own])
    return single.select(*docs.columns).unionByName(judged.select(*docs.columns))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
