"""Vector layers: GeoParquet (WKB column) and GeoPackage, read and written. Other formats are not supported."""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.geometry import LINE, MULTILINE, POINT, polygons_of, read_wkb, reproject
from ..functions.overlay import invalid, union
from ..operators.storage import ship

_POINTS = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])


def read_vector(spark: SparkSession, path: str, layer: str | None = None) -> tuple[DataFrame, int | None]:
    """The layer's columns with `geometry` as WKB, and its EPSG code (null if the file names none). Rows are read by the tasks, those of a GeoPackage
    in ranges of row numbers, from a path that driver and workers share."""
    if path.endswith((".parquet", ".pq")):
        return spark.read.parquet(path), _geoparquet_epsg(spark, path)
    if path.endswith(".gpkg"):
        return read_geopackage(spark, path, layer)
    raise ValueError(f"{path}: only GeoParquet and GeoPackage are supported")


def _geoparquet_epsg(spark: SparkSession, path: str) -> int | None:
    if not os.path.exists(path):  # a store that only Spark reads: its footers aren't at hand
        return None
    one = path if os.path.isfile(path) else next((os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith(".parquet")), None)
    meta = (pq.read_schema(one).metadata or {}) if one else {}
    if b"geo" not in meta:
        return None
    geo = json.loads(meta[b"geo"])
    crs = geo["columns"][geo["primary_column"]].get("crs", {"id": {"code": 4326}})
    return int(crs["id"]["code"]) if crs and "id" in crs else None


class GeoParquetSink(DataSource):
    """A folder of GeoParquet parts, one for each task, whose footers have the geometry's metadata. Options: path (which driver and workers
    share), epsg, geometry."""

    @classmethod
    def name(cls) -> str:
        return "geoparquet"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return GeoParquetWriter(self.options["path"], schema, int(self.options["epsg"]), self.options.get("geometry", "geometry"))


@dataclass
class WrittenPart(WriterCommitMessage):
    name: str
    rows: int


class GeoParquetWriter(DataSourceArrowWriter):
    """Parts are written aside and moved when all tasks are done; what was there before is replaced."""

    def __init__(self, path: str, schema: StructType, epsg: int, geometry: str):
        crs = {"type": "ProjectedCRS" if epsg != 4326 else "GeographicCRS", "name": f"EPSG:{epsg}", "id": {"authority": "EPSG", "code": epsg}}
        geo = {"version": "1.1.0", "primary_column": geometry, "columns": {geometry: {"encoding": "WKB", "geometry_types": [], "crs": crs}}}
        self.path, self.fields, self.geo = path, schema, json.dumps(geo).encode()
        self.aside = f"{path}.parts-{uuid.uuid4().hex}"

    def _schema(self) -> pa.Schema:
        return to_arrow_schema(self.fields).with_metadata({b"geo": self.geo})

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.aside, exist_ok=True)
        name, rows, schema = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet", 0, self._schema()
        with pq.ParquetWriter(f"{self.aside}/{name}", schema) as out:
            for b in batches:
                out.write_table(pa.Table.from_batches([b]).cast(schema))
                rows += b.num_rows
        return WrittenPart(name, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = [m for m in messages if m is not None]
        os.makedirs(self.aside, exist_ok=True)
        if not parts:
            pq.write_table(self._schema().empty_table(), f"{self.aside}/part-00000.parquet")
        for m in parts:
            if pq.ParquetFile(f"{self.aside}/{m.name}").metadata.num_rows != m.rows:
                raise RuntimeError(f"{m.name} does not hold what was written")
        keep = {m.name for m in parts} or {"part-00000.parquet"}
        for name in os.listdir(self.aside):
            if name not in keep:  # of a task that was run twice
                os.remove(f"{self.aside}/{name}")
        if os.path.isfile(self.path):
            os.remove(self.path)
        elif os.path.isdir(self.path):
            shutil.rmtree(self.path)
        os.replace(self.aside, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)


def write_geoparquet(df: DataFrame, path: str, epsg: int, geometry: str = "geometry") -> str:
    """A folder of GeoParquet parts, written by the tasks; its reference system is read back."""
    spark = df.sparkSession
    ship(spark)
    spark.dataSource.register(GeoParquetSink)
    df.write.format("geoparquet").mode("overwrite").option("path", path).option("epsg", str(epsg)).option("geometry", geometry).save()
    if _geoparquet_epsg(spark, path) != epsg:
        raise RuntimeError(f"{path} does not hold what was written")
    return path


def _blob_wkb(blob: bytes) -> bytes:
    """Without the header of a GeoPackage, whose envelope is none, 4, 6, 6 or 8 numbers."""
    if blob[:2] != b"GP":
        return blob
    return blob[8 + 8 * (0, 4, 6, 6, 8)[blob[3] >> 1 & 7] :]


def _layer_of(path: str, layer: str | None) -> tuple[str, str, int, list[tuple[str, str]]]:
    """Name, geometry column, reference system, and columns with their types of a layer."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        layers = [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name")]
        name = layer or (layers[0] if len(layers) == 1 else None)
        if name not in layers:
            raise ValueError(f"{path} has the layers {', '.join(layers)}; name one")
        column, srs = db.execute("SELECT column_name, srs_id FROM gpkg_geometry_columns WHERE table_name = ?", (name,)).fetchone()
        declared = [(r[1], (r[2] or "").upper()) for r in db.execute(f"PRAGMA table_info({_quoted(name)})")]
    finally:
        db.close()
    kind = lambda t: "long" if "INT" in t or t == "BOOLEAN" else "double" if any(k in t for k in ("REAL", "FLOA", "DOUB")) else "string"
    return name, column, srs, [(n, "binary" if n == column else kind(t)) for n, t in declared]


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class GeoPackageSource(DataSource):
    """A layer of a GeoPackage, read by the tasks in ranges of row numbers. Options: path (which driver and workers share), layer, rows of a range."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        _, column, _, columns = _layer_of(self.options["path"], self.options.get("layer"))
        return ", ".join(f"`{'geometry' if n == column else n}` {t}" for n, t in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return GeoPackageReader(self.options["path"], self.options.get("layer"), int(self.options.get("rows", "50000")), schema)


class GeoPackageReader(DataSourceReader):
    def __init__(self, path: str, layer: str | None, rows: int, schema: StructType):
        self.path, self.rows, self.fields = path, rows, schema
        self.name, self.column, _, self.columns = _layer_of(path, layer)

    def partitions(self) -> list[InputPartition]:
        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.name)}").fetchone()
        finally:
            db.close()
        return [Rows(k, min(k + self.rows - 1, high)) for k in range(low, high + 1, self.rows)] if low is not None else [Rows(0, -1)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.fields)
        as_ = {"long": int, "double": float, "string": str}
        change = [(lambda v: bytes(_blob_wkb(v))) if t == "binary" else as_[t] for _, t in self.columns]
        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            cursor = db.execute(f"SELECT {', '.join(_quoted(n) for n, _ in self.columns)} FROM {_quoted(self.name)} WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last))
            while rows := cursor.fetchmany(10_000):
                columns = [[None if v is None else f(v) for v in c] for f, c in zip(change, zip(*rows, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        finally:
            db.close()


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None, rows: int = 50_000) -> tuple[DataFrame, int | None]:
    """A layer's columns, by their declared types, with `geometry` as WKB, and its EPSG code."""
    name, _, srs, _ = _layer_of(path, layer)
    ship(spark)
    spark.dataSource.register(GeoPackageSource)
    return spark.read.format("geopackage").option("path", path).option("layer", name).option("rows", str(rows)).load(), srs


def write_geopackage(path: str, layers: dict[str, tuple[list[dict], str]], epsg: int = 4326) -> str:
    """Layers by name: rows with `geometry` as WKB, and the geometry's type. Replaces the file."""
    if os.path.exists(path):
        os.remove(path)
    db = sqlite3.connect(path)
    try:
        db.executescript("""
            PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;
            CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
            CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME DEFAULT CURRENT_TIMESTAMP, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
            CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);
        """)
        for srs, name in ((-1, "undefined cartesian"), (0, "undefined geographic"), (epsg, f"EPSG:{epsg}")):
            db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", (name, srs, "EPSG" if srs > 0 else "NONE", srs))
        for name, (rows, kind) in layers.items():
            columns = [c for c in (rows[0] if rows else {"geometry": b""}) if c != "geometry"]
            types = {c: next(({int: "INTEGER", float: "REAL", bool: "INTEGER"}.get(type(r[c]), "TEXT") for r in rows if r[c] is not None), "TEXT") for c in columns}
            spec = ", ".join(f'"{c}" {types[c]}' for c in columns)
            db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geometry BLOB{", " + spec if spec else ""})')
            marks = ", ".join("?" * (len(columns) + 1))
            quoted = ", ".join(['geometry', *(f'"{c}"' for c in columns)])
            head = b"GP" + struct.pack("<BBi", 0, 1, epsg)
            db.executemany(f'INSERT INTO "{name}" ({quoted}) VALUES ({marks})', [(head + bytes(r["geometry"]), *(r[c] for c in columns)) for r in rows])
            db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (name, name, epsg))
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geometry', ?, ?, 0, 0)", (name, kind, epsg))
        db.commit()
    finally:
        db.close()
    return path


def _decoded(df: DataFrame, schema: StructType, one) -> DataFrame:
    """df without geometry, with the columns that `one` makes of each geometry, a list of tuples: a row for each."""
    names = [c for c in df.columns if c != "geometry"]
    out = StructType([*[df.schema[c] for c in names], *schema.fields])
    kinds = {f.name: pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])) if f.name == "coords" else {"double": pa.float64(), "integer": pa.int32()}[f.dataType.typeName()] for f in schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, made = [], []
            for i, g in enumerate(b.column("geometry").to_pylist()):
                for row in one(g):
                    at.append(i)
                    made.append(row)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in names), *(pa.array([r[k] for r in made], kinds[f.name]) for k, f in enumerate(schema.fields))], names=out.names)

    return df.mapInArrow(run, out)


def points_of(df: DataFrame, source: int | None = None, target: int | None = None) -> DataFrame:
    """Columns x and y of points, in another reference system if both codes are given; any other geometry is an error."""

    def one(g):
        kind, p = read_wkb(g) if g else (0, None)
        if kind != POINT:
            raise ValueError("every point must have a point geometry")
        return [reproject(*p, source, target) if source and target else p]

    return _decoded(df, _POINTS, one)


def lines_of(df: DataFrame) -> DataFrame:
    """line_id, part, coords of lines; any other geometry is an error."""

    def one(g):
        kind, parts = read_wkb(g) if g else (0, None)
        if kind not in (LINE, MULTILINE):
            raise ValueError("roads must be lines")
        return [(k, [{"x": x, "y": y} for x, y in p]) for k, p in enumerate([parts] if kind == LINE else parts)]

    schema = StructType([StructField("part", IntegerType()), StructField("coords", ArrayType(_POINTS))])
    return _decoded(df.select(F.monotonically_increasing_id().alias("line_id"), "geometry"), schema, one)


def boundary_of(df: DataFrame, source: int | None = None, target: int | None = None):
    """The polygons of a boundary layer, united: one geometry for the driver, reprojected corner by corner. Features may overlap; each must be valid."""
    out = []
    for r in df.select("geometry").collect():
        for p in polygons_of(read_wkb(bytes(r[0]))) if r[0] else []:
            out.append([[reproject(x, y, source, target) if source and target else (x, y) for x, y in ring] for ring in p])
    if not out:
        raise ValueError("the boundary has no polygon")
    return united(out)


def united(polygons: list) -> list:
    """Valid polygons as one valid geometry; a single one stays as it is."""
    for p in polygons:
        if why := invalid([p]):
            raise ValueError(f"the boundary is not valid: {why}")
    return union(polygons) if len(polygons) > 1 else polygons
