"""Input-output tables: CSV, Parquet and XLSX, as plain squares or as presentation sheets; shipped data is not needed."""

from __future__ import annotations

import csv
import hashlib
import math
import os
import re
import zipfile
from dataclasses import dataclass
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from ..functions.sectors import label_of, sector_id_of

#: Sectors of each classification.
SECTORS = {"io16": 16, "io80": 80}
LONG = "source string, target string, value double"


@dataclass(frozen=True)
class Provenance:
    source_id: str
    source_kind: str
    source_path: str | None = None
    resource_sha256: str | None = None


def _xlsx_cells(path: str, sheet: str | int) -> list[list[object]]:
    """A worksheet as rows of values, by the format's own parts: shared strings, the list of sheets, and the sheet."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{space}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")]
        sheets = [(s.get("name"), s.get(link)) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{space}sheet")]
        found = [r for n, r in sheets if n == sheet] if isinstance(sheet, str) else [sheets[sheet][1]] if sheet < len(sheets) else []
        if not found:
            raise ValueError(f"{path} has no sheet {sheet!r}")
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = rels[found[0]]
        tree = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    rows: dict[int, dict[int, object]] = {}
    for c in tree.iter(f"{space}c"):
        letters, digits = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
        col = 0
        for x in letters:
            col = col * 26 + ord(x) - 64
        v, kind = c.find(f"{space}v"), c.get("t")
        if kind == "inlineStr":
            value: object = "".join(t.text or "" for t in c.iter(f"{space}t"))
        elif v is None or v.text is None:
            continue
        else:
            value = shared[int(v.text)] if kind == "s" else v.text if kind in ("str", "e") else float(v.text)
            if isinstance(value, float) and value.is_integer():
                value = int(value)
        rows.setdefault(int(digits) - 1, {})[col - 1] = value
    width = max((c for r in rows.values() for c in r), default=-1) + 1
    return [[rows.get(r, {}).get(c) for c in range(width)] for r in range(max(rows, default=-1) + 1)]


def read_cells(path: str, sheet: str | int = 0) -> list[list[object]]:
    """A table's cells, its header first. Tables are at most some hundred rows: the classification's sectors and titles."""
    suffix = Path(path).suffix.lower()
    if suffix == ".csv":
        with open(path, newline="", encoding="utf-8-sig") as f:
            return [[v if v != "" else None for v in r] for r in csv.reader(f)]
    if suffix in (".parquet", ".pq"):
        import pyarrow.parquet as pq

        t = pq.read_table(path)
        return [list(t.column_names), *[list(r.values()) for r in t.to_pylist()]]
    if suffix in (".xlsx", ".xlsm"):
        return _xlsx_cells(path, sheet)
    raise ValueError(f"{path}: tables are CSV, Parquet, XLSX or XLSM")


def find_block(cells: list[list[object]], n: int) -> tuple[int, int, int, int] | None:
    """Header row, first data column, first data row and label column of the first n by n block whose labels stand above it and,
    alike, to the left of it."""
    tokens = [[label_of(v) for v in r] for r in cells]
    width = max(map(len, tokens), default=0)
    tokens = [r + [None] * (width - len(r)) for r in tokens]
    at: dict[tuple, list[tuple[int, int]]] = {}
    for c in range(width):
        for r in range(len(tokens) - n + 1):
            run = tuple(tokens[r + k][c] for k in range(n))
            if None not in run and len(set(run)) == n:
                at.setdefault(run, []).append((r, c))
    for h, row in enumerate(tokens):
        for c in range(width - n + 1):
            places = at.get(tuple(row[c : c + n]), ())
            for r, left in sorted(places):
                if r > h and left < c:
                    return h, c, r, left
    return None


def _number(v: object, what: str) -> float:
    try:
        x = float(str(v).replace(",", "")) if v is not None else math.nan
    except ValueError:
        x = math.nan
    if not math.isfinite(x):
        raise ValueError(f"{what}: {v!r} is not a finite number")
    return x


def read_io_table(spark: SparkSession, path: str, sheet: str | int = 0, sectors: int | None = None) -> DataFrame:
    """source, target, value of a square table: first column the suppliers, header the users; or a presentation sheet's block.

    With a size, sectors that aren't numbered 01 to N are renamed so by position."""
    cells = read_cells(path, sheet)
    header, body = cells[0], [r for r in cells[1:] if any(v is not None for v in r)]
    names = [sector_id_of(v) for v in header[1:] if v is not None]
    square = len(body) == len(names) and len(names) > 0 and (sectors is None or len(names) == sectors)
    rows: list[tuple[str, str, float]]
    if square and {sector_id_of(r[0]) for r in body} == set(names):
        if len(set(names)) != len(names):
            raise ValueError("repeated sectors")
        suppliers = [sector_id_of(r[0]) for r in body]
        rows = [(s, t, _number(v, f"{s}, {t}")) for s, r in zip(suppliers, body, strict=True) for t, v in zip(names, r[1:], strict=False)]
        order = suppliers
    elif sectors and (block := find_block(cells, sectors)):
        h, c, r0, left = block
        order = [f"#{k}" for k in range(sectors)]
        rows = [(order[i], order[j], _number(cells[r0 + i][c + j], f"row {r0 + i}, column {c + j}")) for i in range(sectors) for j in range(sectors)]
    else:
        raise ValueError(f"{path} has no square table" + (f" of {sectors} sectors" if sectors else ""))
    if sectors:
        canonical = [f"{k + 1:02d}" for k in range(sectors)]
        if order != canonical:
            new = dict(zip(order, canonical, strict=True))
            rows = [(new[s], new[t], v) for s, t, v in rows]
    if any(v < 0 for _, _, v in rows):
        raise ValueError("values must not be negative")
    return spark.createDataFrame(rows, LONG)


def read_total_output(spark: SparkSession, path: str, sheet: str | int = 0, sectors: int = 16) -> DataFrame:
    """sector, total_output from the one column headed "total output" to the right of a presentation sheet's block."""
    cells = read_cells(path, sheet)
    if (block := find_block(cells, sectors)) is None:
        raise ValueError(f"{path} has no block of {sectors} sectors")
    h, c, r0, _ = block
    width = max(map(len, cells))
    columns = [k for k in range(c + sectors, width) if any(k < len(r) and label_of(r[k]) == "total output" for r in cells[:r0])]
    if len(columns) != 1:
        raise ValueError(f"{len(columns)} columns of total output; exactly one is needed")
    values = [_number(cells[r0 + i][columns[0]], f"total output of sector {i + 1}") for i in range(sectors)]
    if min(values) <= 0:
        raise ValueError("total output must be positive")
    return spark.createDataFrame([(f"{i + 1:02d}", v) for i, v in enumerate(values)], "sector string, total_output double")


def read_output_vector(spark: SparkSession, path: str, sectors: int) -> DataFrame:
    """sector, total_output of a file with these two columns and sectors 01 to N, each once."""
    cells = read_cells(path)
    if [label_of(v) for v in cells[0][:2]] not in (["sector", "total output"], ["sector", "total_output"]):
        raise ValueError("the columns must be sector and total_output")
    rows = [(sector_id_of(r[0]), _number(r[1], str(r[0]))) for r in cells[1:] if r and r[0] is not None]
    if [s for s, _ in sorted(rows)] != [f"{k + 1:02d}" for k in range(sectors)] or min(v for _, v in rows) <= 0:
        raise ValueError("sectors must be 01 to N, each once, with positive output")
    return spark.createDataFrame(rows, "sector string, total_output double")


def text_sha256(data: bytes) -> str:
    """Of a text whatever its line ends."""
    return hashlib.sha256(data.replace(b"\r\n", b"\n").replace(b"\r", b"\n")).hexdigest()


#: SHA-256 of the public tables of 2018, transactions and total output, as text with line feeds.
PUBLIC = {
    "io80": ("psa_2018_io80", "9335f4de98d6b11205b431f8702f26a2c932d641fdd911ce7ddcf08f604840a1", "7159ef3cdc7368d949b4846e21927ddba3c5d116c7cceafcd9efd48273aca061"),
    "io16": ("psa_2018_io16", "f5a2105fc67d2c992eb86531b310b0ce7eff3046a981da88570cea196a49ba76", "8b5653e65002fbedcb7602793da044c4a13cd9664bc0e7f8d7d41ebe9f53e9cf"),
}


def packaged(folder: str | None, classification: str) -> tuple[str, str | None, Provenance]:
    """The folder's transactions and output files of a classification: those of the public tables by their own names, which must be unchanged, else any named
    <classification>.csv and <classification>_total_output.csv."""
    folder = folder or os.environ.get("WAYLATTICE_IO_DATA", "")
    public, *hashes = PUBLIC[classification]
    stem = public if os.path.isfile(os.path.join(folder, f"{public}.csv")) else classification
    z, x = os.path.join(folder, f"{stem}.csv"), os.path.join(folder, f"{stem}_total_output.csv")
    if not os.path.isfile(z):
        raise FileNotFoundError(f"no transactions for {classification} in {folder or 'the data folder'}")
    found = [text_sha256(Path(p).read_bytes()) if os.path.isfile(p) else None for p in (z, x)]
    if stem == public:
        for path, sha, expected in zip((z, x), found, hashes, strict=True):
            if sha is not None and sha != expected:
                raise ValueError(f"{path} is not the expected file: SHA-256 {sha}, not {expected}")
    return z, x if found[1] else None, Provenance(stem, "packaged", z, found[0])


def load_pair(spark: SparkSession, classification: str, transactions: str | None = None, sheet: str | int = 0, coefficients: str | None = None, coefficients_sheet: str | int = 0, folder: str | None = None) -> tuple[DataFrame, DataFrame, Provenance]:
    """Transactions and technical coefficients: of explicit coefficients, a packaged output vector, and the workbook's own total
    output, the first that there is."""
    from ..operators.io_graph import technical_coefficients

    n = SECTORS[classification]
    if transactions:
        z, found = read_io_table(spark, transactions, sheet, n), Provenance(Path(transactions).name, "file", transactions, None)
        x_path = None
    else:
        path, x_path, found = packaged(folder, classification)
        z = read_io_table(spark, path, 0, n)
    if coefficients:
        return z, read_io_table(spark, coefficients, coefficients_sheet, n), found
    x = read_output_vector(spark, x_path, n) if x_path else read_total_output(spark, transactions, sheet, n)
    return z, technical_coefficients(z, x), found
