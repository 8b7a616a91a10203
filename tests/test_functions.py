import math

import pytest
from pyspark.sql import functions as F

from waylattice.functions import geometry as g
from waylattice.functions.overlay import invalid
from waylattice.functions.sectors import node_id, node_id_of, sector_id, sector_id_of, sheet_of


def test_sector_ids(spark):
    given = ["01", "1", "1.0", " 1.0 ", "80", "A", "  ", "12345678901234567890.0", "+5", "-1", "-0", "007", None, "1.5", "0"]
    want = ["01", "01", "01", "01", "80", "A", None, "12345678901234567890", "05", "-1", "00", "07", None, "1.5", "00"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    assert [r[0] for r in df.orderBy("i").select(sector_id(F.col("v"))).collect()] == want
    assert [sector_id_of(v) for v in given] == want


def test_node_ids(spark):
    for t in ("01", "a b", "x*y~z", "é/ü"):
        got = spark.createDataFrame([(t, 3)], "t string, c long").select(node_id(F.col("t"), F.col("c"))).first()[0]
        assert got == node_id_of(t, 3)
    assert node_id_of("a b*", 1) == "type=a%20b%2A::cluster=1"


def test_sheets():
    assert sheet_of("0") == 0 and sheet_of("Z") == "Z"


def test_wkb_round_trip():
    square = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]]
    assert g.read_wkb(g.point_wkb(1.5, -2)) == (g.POINT, (1.5, -2.0))
    assert g.read_wkb(g.line_wkb([(0, 0), (1, 1)])) == (g.LINE, [(0.0, 0.0), (1.0, 1.0)])
    assert g.read_wkb(g.multipolygon_wkb([square])) == (g.MULTIPOLYGON, [square])
    import struct

    with_z = struct.pack("<BI", 1, 1001) + struct.pack("<ddd", 1, 2, 3)
    assert g.read_wkb(with_z) == (g.POINT, (1.0, 2.0))


def test_clip_and_area():
    triangle = [[[(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]]]
    assert g.area(triangle) == 8
    assert g.area(g.clip(triangle, (0, 0, 2, 2))) == 4
    assert g.area(g.clip(triangle, (2, 2, 4, 4))) == 0
    x, y = g.interior_point(g.clip(triangle, (2, 0, 4, 2)))
    assert x + y < 4 and x > 2 and y > 0
    assert invalid([[triangle[0][0]]]) is None and invalid([[[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]]]) is not None


def test_outlines_keep_area():
    cells = {(x, y) for x in range(5) for y in range(5)} - {(2, 2)} | {(6, 6), (7, 7)}
    polygons = g.outline(cells)
    assert len(polygons) == 3 and sorted(map(len, polygons)) == [1, 1, 2]
    assert g.area(polygons) == len(cells)


@pytest.mark.parametrize("epsg", [3857, 32651, 32733])
def test_projections_round_trip(epsg):
    lon, lat = (121.0, 14.6) if epsg != 32733 else (15.7, -22.5)
    x, y = g.from_wgs84(lon, lat, epsg)
    back = g.to_wgs84(x, y, epsg)
    assert math.isclose(back[0], lon, abs_tol=1e-8) and math.isclose(back[1], lat, abs_tol=1e-8)


def test_utm_middle_meridian():
    x, y = g.from_wgs84(123.0, 0.0, 32651)
    assert math.isclose(x, 500_000, abs_tol=1e-6) and abs(y) < 1e-6
    with pytest.raises(ValueError):
        g.to_wgs84(0, 0, 2154)
