"""A pipeline over documents: quality, exact copies, near copies, benchmark passages, and the mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waylattice.llm.common import crc_mod, materialize, table
from waylattice.llm.decontaminate import contamination, find_spans
from waylattice.llm.exact_dedup import keep_first
from waylattice.llm.jaccard_join import keep_one_of_each
from waylattice.llm.mixing import mix_sources
from waylattice.llm.quality import accepted, fit_quality, labelled, statistics_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, fitted on the labelled ones among them, scores under 0.7."""
    labels = table(spark, sf_dir, "labels")
    model = fit_quality(statistics_table(labelled(docs, labels), crc_mod(4) != 2), labels)
    return accepted(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for whitespace, keep the one with the smallest id."""
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose shingle sets link, keep the one with the smallest id."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth of the words or more lies in benchmark windows."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # the operator's own names may be among the columns
    rows = docs.toDF(*names)
    found = contamination(find_spans(rows, table(spark, sf_dir, "benchmark"), text_col=names[docs.columns.index("text")], carry=tuple(names)))
    return found.where("not contaminated").select(*names).toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of the documents that are left: their ids, sources and words taken."""
    return mix_sources(docs).where("taken > 0")


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("benchmark decontamination", decontaminate), ("mixing sources to target weights", mix)]

#: The classifier can't be expressed in SQL; tests compare the pipeline with a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
