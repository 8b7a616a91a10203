import csv
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from waylattice import cli
from waylattice.operators import paths
from waylattice.functions.geometry import line_wkb, multipolygon_wkb, point_wkb
from waylattice.sources import iotable
from waylattice.sources.area import area_boundary, load_area
from waylattice.sources.vectors import read_geopackage, read_vector, write_geopackage, write_geoparquet

EPSG = 32651


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("inputs")
    x0, y0 = 300_000.0, 1_600_000.0
    roads = [{"geometry": line_wkb([(x0 + i * 100, y0), (x0 + i * 100, y0 + 2000)])} for i in range(0, 21, 5)] + [{"geometry": line_wkb([(x0 + i * 100, y0 + j * 100) for i in range(0, 21, 5)])} for j in range(0, 21, 5)]
    write_geopackage(str(d / "roads.gpkg"), {"roads": (roads, "LINESTRING")}, EPSG)
    rows = []
    for t in range(1, 5):
        for group, (gx, gy) in enumerate(((150, 0), (1800, 2000))):
            rows += [(f"{t}-{group}-{k}", f"p{t}", str(t), bytearray(point_wkb(x0 + gx + 7 * k + t, y0 + gy + (3 if gy == 0 else -3)))) for k in range(7)]
    p = spark.createDataFrame(rows, "canonical_id string, name string, io16_code string, geometry binary")
    write_geoparquet(p, str(d / "points.parquet"), EPSG)
    ring = [(x0 - 50, y0 - 50), (x0 + 2050, y0 - 50), (x0 + 2050, y0 + 2050), (x0 - 50, y0 + 2050), (x0 - 50, y0 - 50)]
    write_geopackage(str(d / "boundary.gpkg"), {"b": ([{"geometry": multipolygon_wkb([[ring]])}], "MULTIPOLYGON")}, EPSG)
    with open(d / "z.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["sector", *[f"{k:02d}" for k in range(1, 17)]])
        w.writerows([[f"{i:02d}", *[(i * 7 + j * 3) % 23 + 1 for j in range(1, 17)]] for i in range(1, 17)])
    with open(d / "a.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["sector", *[f"{k:02d}" for k in range(1, 17)]])
        w.writerows([[f"{i:02d}", *[((i * 7 + j * 3) % 23 + 1) / 1000 for j in range(1, 17)]] for i in range(1, 17)])
    return d


def common_of(inputs):
    return ["--roads", str(inputs / "roads.gpkg"), "--classification", "io16", "--transactions", str(inputs / "z.csv"), "--technical-coefficients", str(inputs / "a.csv"), "--no-progress"]


def run_of(inputs):
    return ["run", "--points", str(inputs / "points.parquet"), "--boundary", str(inputs / "boundary.gpkg"), "--voronoi-resolution", "100", *common_of(inputs)]


@pytest.fixture(scope="module")
def finished(spark, inputs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("finished") / "out")
    assert cli.main([*run_of(inputs), "--output-dir", out], spark) == 0
    return out


def test_run_and_restart(spark, inputs, finished, tmp_path):
    out, common = finished, common_of(inputs)
    meta = json.load(open(f"{out}/run_metadata.json"))
    assert meta["cluster_count"] == 8 and meta["scored_points"] == 56 and meta["x_nodes"] == 8
    rows = list(csv.DictReader(open(f"{out}/X_nodes.csv")))
    assert [r["node_id"] for r in rows] == sorted(r["node_id"] for r in rows) and 120 < float(rows[0]["lon"]) < 123
    areas = spark.read.parquet(f"{out}/partition_cells.parquet").groupBy("type").agg(F.sum("area").alias("a")).collect()
    assert all(r["a"] == pytest.approx(2100**2) for r in areas)
    for layer, n in (("clusters", 8), ("nodes", 8), ("paths", meta["x_edges"])):
        df, srs = read_geopackage(spark, f"{out}/spatial_outputs.gpkg", layer)
        assert df.count() == n and srs == 4326
    assert os.path.exists(f"{out}/OUTPUTS.txt")
    again = str(tmp_path / "again")
    code = cli.main(["from-partitions", "--partitions", f"{out}/partitions.parquet", "--output-dir", again, *common], spark)
    assert code == 0
    a, b = (spark.read.parquet(f"{d}/points_centrality.parquet").select("point_id", F.round("score", 9).alias("score")) for d in (out, again))
    assert a.count() == 56 and a.exceptAll(b).count() == 0


    # partitions of anyone else come without cells
    alone = tmp_path / "alone"
    alone.mkdir()
    part, _ = read_vector(spark, f"{out}/partitions.parquet")
    write_geoparquet(part.withColumn("note", F.lit("x")), str(alone / "partitions.parquet"), EPSG)
    code = cli.main(["from-partitions", "--partitions", str(alone / "partitions.parquet"), "--centers", f"{out}/network_centers.parquet", "--points-with-center-distance", f"{out}/points_with_center_distance.parquet", "--output-dir", str(alone / "out"), *common], spark)
    assert code == 0
    c = spark.read.parquet(str(alone / "out" / "points_centrality.parquet")).select("point_id", F.round("score", 9).alias("score"))
    assert c.count() == 56 and a.exceptAll(c).count() == 0


def test_run_beyond_the_kernel(spark, inputs, finished, tmp_path, monkeypatch):
    """The whole workflow with every search by relaxation, paths included, gives the same files."""
    monkeypatch.setattr(paths, "KERNEL_ARCS", 0)
    out = str(tmp_path / "out")
    assert cli.main([*run_of(inputs), "--output-dir", out], spark) == 0
    scores = lambda d: spark.read.parquet(f"{d}/points_centrality.parquet").select("point_id", "cluster", F.round("score", 9).alias("score"))
    assert scores(out).count() == 56 and scores(out).exceptAll(scores(finished)).count() == 0
    edges = lambda d: sorted(tuple(r.values()) for r in csv.DictReader(open(f"{d}/X_edges.csv")))
    assert edges(out) == edges(finished)
    lines = lambda d: sorted(map(str, read_geopackage(spark, f"{d}/spatial_outputs.gpkg", "paths")[0].collect()))
    assert lines(out) == lines(finished)


def test_errors_are_reported(spark, inputs, capsys):
    assert cli.main(["run", "--points", "none.parquet", "--boundary", "none.gpkg", "--roads", "none.gpkg"], spark) == 1
    assert "error:" in capsys.readouterr().err


def test_area_catalog(spark, inputs, tmp_path):
    (tmp_path / "areas.yml").write_text("areas:\n  metro:\n    name: Metro\n    kind: region\n    aliases: [MM]\n    bbox: [120.9, 14.4, 121.1, 14.8]\n")
    area = load_area("mm", str(tmp_path / "areas.yml"))
    assert area.slug == "metro"
    path = area_boundary(spark, area, str(tmp_path / "b.gpkg"))
    df, srs = read_vector(spark, path)
    assert df.count() == 1 and srs == 4326
    with pytest.raises(ValueError):
        load_area("nowhere", str(tmp_path / "areas.yml"))


def test_presentation_block(spark, tmp_path):
    labels = ["Farms", "Mines", "Mills"]
    sheet = [["Table 1"], [], ["", "code", *labels, "Total Output"], *[[str(i), n, *[i * 3 + j + 1 for j in range(3)], 100 + i] for i, n in enumerate(labels)], ["", "all", 1, 2, 3, 4]]
    with open(tmp_path / "t.csv", "w", newline="") as f:
        csv.writer(f).writerows(sheet)
    z = {(r["source"], r["target"]): r["value"] for r in iotable.read_io_table(spark, str(tmp_path / "t.csv"), 0, 3).collect()}
    assert z["01", "01"] == 1 and z["03", "02"] == 8
    x = {r["sector"]: r["total_output"] for r in iotable.read_total_output(spark, str(tmp_path / "t.csv"), 0, 3).collect()}
    assert x == {"01": 100, "02": 101, "03": 102}


def test_xlsx(spark, tmp_path):
    def cell(r, c, v):
        ref = f"{chr(65 + c)}{r + 1}"
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{ref}"><v>{v}</v></c>'

    rows = [["s", "1", "2"], ["1", 5, 6.5], ["2", 7, 8]]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    path = tmp_path / "z.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Z" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{i + 1}">' + "".join(cell(i, j, v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows)) + "</sheetData></worksheet>")
    got = {(r["source"], r["target"]): r["value"] for r in iotable.read_io_table(spark, str(path), "Z", None).collect()}
    assert got == {("01", "01"): 5, ("01", "02"): 6.5, ("02", "01"): 7, ("02", "02"): 8}
    assert iotable.text_sha256(b"a\r\nb") == iotable.text_sha256(b"a\nb")


def test_public_tables_must_be_unchanged(spark, tmp_path, monkeypatch):
    """Files under their public names are held against their hashes, whatever their line ends; other names are anyone's."""
    head = "sector," + ",".join(f"{k:02d}" for k in range(1, 17))
    text = "\n".join([head, *(f"{i:02d}," + ",".join(str(i + j) for j in range(16)) for i in range(1, 17))]) + "\n"
    output = "sector,total_output\n" + "".join(f"{i:02d},{1000 * i}\n" for i in range(1, 17))
    (tmp_path / "psa_2018_io16.csv").write_bytes(text.replace("\n", "\r\n").encode())
    (tmp_path / "psa_2018_io16_total_output.csv").write_text(output)
    with pytest.raises(ValueError, match="not the expected file"):
        iotable.load_pair(spark, "io16", folder=str(tmp_path))
    hashes = [iotable.text_sha256(t.encode()) for t in (text, output)]
    monkeypatch.setitem(iotable.PUBLIC, "io16", ("psa_2018_io16", *hashes))
    z, a, found = iotable.load_pair(spark, "io16", folder=str(tmp_path))
    assert z.count() == 256 and found.resource_sha256 == hashes[0] and found.source_id == "psa_2018_io16"
    assert a.where("source = '01' and target = '02'").first()["value"] == pytest.approx(2 / 2000)
    (tmp_path / "psa_2018_io16_total_output.csv").write_text(output + "17,1\n")
    with pytest.raises(ValueError, match="total_output.csv is not the expected"):
        iotable.load_pair(spark, "io16", folder=str(tmp_path))
