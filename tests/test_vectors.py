"""Vector files as Spark sources and sinks: rows stay in the tasks."""

import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from waylattice.functions.geometry import point_wkb
from waylattice.sources import vectors


def rows(n):
    return [(k, f"name {k}" if k % 3 else None, k / 4, bytearray(point_wkb(k, -k))) for k in range(n)]


def test_geoparquet_parts_have_the_metadata(spark, tmp_path):
    path = str(tmp_path / "points.parquet")
    df = spark.createDataFrame(rows(1000), "id long, name string, size double, geometry binary").repartition(5)
    assert vectors.write_geoparquet(df, path, 32651) == path
    parts = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))
    assert len(parts) == 5
    for f in parts:
        geo = json.loads(pq.read_schema(f"{path}/{f}").metadata[b"geo"])
        assert geo["primary_column"] == "geometry" and geo["columns"]["geometry"]["crs"]["id"]["code"] == 32651
    back, epsg = vectors.read_vector(spark, path)
    assert epsg == 32651 and back.exceptAll(df).count() == 0 and back.count() == 1000
    # written again, over a folder and over a file, and with no rows at all
    vectors.write_geoparquet(df.limit(3), path, 4326)
    assert vectors.read_vector(spark, path)[0].count() == 3 and vectors._geoparquet_epsg(spark, path) == 4326
    (tmp_path / "file.parquet").write_bytes(b"old")
    vectors.write_geoparquet(df.where("id < 0"), str(tmp_path / "file.parquet"), 4326)
    assert vectors.read_vector(spark, str(tmp_path / "file.parquet"))[0].count() == 0
    assert {*os.listdir(tmp_path)} == {"points.parquet", "file.parquet"}


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "points.parquet")
    df = spark.createDataFrame(rows(20), "id long, name string, size double, geometry binary")
    vectors.write_geoparquet(df, path, 4326)
    with pytest.raises(Exception):  # noqa: B017 - from a task
        vectors.write_geoparquet(df.withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id"))), path, 32651)
    assert vectors.read_vector(spark, path)[0].count() == 20 and os.listdir(tmp_path) == ["points.parquet"]


def test_geopackage_in_ranges(spark, tmp_path):
    path = str(tmp_path / "v.gpkg")
    vectors.write_geopackage(path, {"a": ([{"k": k, "t": f"x{k}" if k % 2 else None, "d": k / 2, "geometry": point_wkb(k, 1)} for k in range(95)], "POINT"), "none": ([], "POINT")}, 32651)
    df, srs = vectors.read_geopackage(spark, path, "a", rows=10)
    assert srs == 32651 and df.rdd.getNumPartitions() == 10
    assert dict(df.dtypes) == {"fid": "bigint", "geometry": "binary", "k": "bigint", "t": "string", "d": "double"}
    got = df.orderBy("k").collect()
    assert [r["k"] for r in got] == list(range(95)) and [r["d"] for r in got] == [k / 2 for k in range(95)] and got[0]["t"] is None and bytes(got[3]["geometry"]) == point_wkb(3, 1)
    assert vectors.points_of(df).where("x = k and y = 1").count() == 95
    assert vectors.read_geopackage(spark, path, "none")[0].count() == 0
    with pytest.raises(ValueError, match="name one"):
        vectors.read_geopackage(spark, path)
