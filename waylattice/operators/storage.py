"""Tables that cut lineage, distributed numbering, and checks."""

from __future__ import annotations

import contextlib
import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one if all tasks run in this process, as in
    tests; else an error, as executors would write where others cannot read."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers of a session this package, as a zip in the shared folder: their functions and broadcasts name its modules, which need not be
    on a worker's own path. Once for each application; the queries and materialize() call it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/code/{sc.applicationId}/{os.path.basename(root)}.zip")
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = files.create(path, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(files.makeQualified(path).toString())
    _SHIPPED.add(sc.applicationId)


#: With it, the shuffle files of a query are removed from all executors as soon as the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files: what they wrote is read from its files, never from their shuffles."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def dealt(df: DataFrame) -> DataFrame:
    """The rows over several partitions for each core: a small file that costs much to work on would be one task's, and rows that a shuffle brings together by
    their bytes too."""
    sc = df.sparkSession.sparkContext
    return df.repartition(max(4 * sc.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


#: Rows of a file of a table whose size is known before it is written.
FILE_ROWS, LEAST_FILES = 50_000, 8


def materialize(df: DataFrame, tag: str, rows: int | None = None, hashes: bool = False) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage of loops, and survives the loss of executors.

    rows: how many there are at most, if known; a small table is then written as a few files, not one for each partition.
    hashes: most values are different, so no dictionaries of them are tried."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))
    with shuffles_removed(spark):
        df.write.option("parquet.enable.dictionary", str(not hashes).lower()).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._table_path = path
    return written


def extended(table: DataFrame, df: DataFrame) -> DataFrame:
    """A table of materialize() with the rows of df, which has the same columns, written to it too."""
    spark = df.sparkSession
    with shuffles_removed(spark):
        df.write.mode("append").option("parquet.enable.dictionary", "false").parquet(table._table_path)
    out = spark.read.schema(table.schema).parquet(table._table_path)
    out._table_path = table._table_path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a table of materialize() that nothing reads any more."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._table_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a table that a join sends to all tasks (some numbers each).
SENT_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A written table, with the hint to broadcast it to the rows that it is joined with, unless it has too many."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in a global order, without a task that holds all rows: ranges are sorted apart, and each
    begins with the number of rows in the ranges before it."""
    parts = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)),
        "numbered",
    )
    sizes = parts.groupBy("part_").count()  # a row for each range
    before = sizes.withColumn("before_", F.sum("count").over(Window.orderBy("part_")) - F.col("count")).select("part_", "before_")
    return parts.join(F.broadcast(before), "part_").withColumn(name, F.col("at_") + F.col("before_") + start).drop("part_", "at_", "before_")


def require(df: DataFrame, message: str, show: int = 10) -> None:
    """Raise ValueError if df, the rows that break a rule, has any."""
    if bad := df.limit(show).collect():
        raise ValueError(f"{message}: {', '.join(str(tuple(r)) for r in bad)}")
