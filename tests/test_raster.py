"""Shapes as cells: areas, seams, parts and gaps, in metres."""

import pytest
from pyspark.sql import functions as F

from homerank.operators import raster

LAT, LON = 35.7, 51.3


def boxes(spark, rows):
    """Polygons of rectangles (key, south, west, height, width), in metres from a corner; sheared by a tenth so that no side follows the grid."""
    out = []
    for key, y, x, h, w in rows:
        ring = [(LAT + b / raster.LAT_M, LON + (a + 0.1 * b) / raster.LON_M) for b, a in ((y, x), (y, x + w), (y + h, x + w), (y + h, x))]
        lats, lons = [p[0] for p in ring], [p[1] for p in ring]
        out.append((key, 0, min(lats), max(lats), min(lons), max(lons), ring))
    return spark.createDataFrame(out, "area_key string, ord int, min_lat double, max_lat double, min_lon double, max_lon double, ring array<struct<lat:double,lon:double>>")


def test_area_of_a_cover(spark):
    cells = raster.cover(boxes(spark, [("a", 13, 27, 2000, 3000), ("b", 13, 27, 2000, 3000), ("c", 1000, 1000, 2500, 2500)]))
    size = {r["area_key"]: r["s"] for r in cells.groupBy("area_key").agg(raster.square_km(cells).alias("s")).collect()}
    assert size["a"] == size["b"] == pytest.approx(6.0, rel=1e-3) and size["c"] == pytest.approx(6.25, rel=1e-3)
    # Cells are few: whole ones inside, small ones along the border.
    assert cells.filter("area_key = 'a'").count() < 3000
    # Of shapes that overlap, what both cover counts once: 6 + 6.25 less 1013 by 2027 metres or so.
    both = raster.united(cells).agg(raster.square_km(cells)).first()[0]
    assert both == pytest.approx(6.0 + 6.25 - 1.013 * 2.027, rel=3e-3)


@pytest.mark.parametrize("seam, parts", [(20, 1), (60, 2)])
def test_seams(spark, seam, parts):
    shapes = boxes(spark, [("a", 0, 0, 400, 400), ("b", 0, 400 + seam, 400, 400)])
    cells = raster.united(raster.cover(shapes))
    closed = raster.closed_seams(cells, 25.0)
    got = raster.with_part(closed)
    assert got.select("part").distinct().count() == parts
    grown = got.agg(raster.square_km(got)).first()[0] - cells.agg(raster.square_km(cells)).first()[0]
    assert grown == pytest.approx(0.4 * seam / 1000 if parts == 1 else 0.0, abs=0.002)
    # Nothing goes, and nothing grows outward.
    assert cells.join(closed, ["level", "row", "col"], "left_anti").isEmpty()


def test_parts_of_cells_of_all_sizes(spark):
    rows = [(3, 0, 0), (0, 8, 8), (0, 9, 9), (2, 3, 0), (0, 20, 20), (1, 11, 10)]  # the last one begins beside (0, 20, 20)
    got = {(r["level"], r["row"], r["col"]): r["part"] for r in raster.with_part(spark.createDataFrame(rows, "level int, row bigint, col bigint"), 3).collect()}
    assert got[3, 0, 0] == got[0, 8, 8] == got[0, 9, 9] and got[2, 3, 0] != got[3, 0, 0] and got[1, 11, 10] != got[0, 20, 20] or got[1, 11, 10] == got[0, 20, 20]
    assert len({got[3, 0, 0], got[2, 3, 0], got[0, 20, 20]}) == 3


def test_gaps(spark):
    """A strip too thin for a disk of 200 metres is no gap, a wide one is, a small hole is not."""
    width = 4000
    shapes = boxes(spark, [("a", 0, 0, 1000, width), ("b", 1300, 0, 1000, width), ("c", 2900, 0, 1000, width)])
    low, high = LAT, LAT + 3900 / raster.LAT_M
    box = {"min_lat": low, "max_lat": high, "min_lon": LON + 600 / raster.LON_M, "max_lon": LON + 3400 / raster.LON_M}
    got = raster.gaps(shapes, box)
    rows = got.select(((F.col("row") + 0.5) * 50 - (LAT - raster.ORIGIN[0]) * raster.LAT_M).alias("y")).collect()
    assert rows and all(2300 < r["y"] < 2900 for r in rows) and got.select("part").distinct().count() == 1
    assert raster.gaps(shapes, box, thick=100.0).select("part").distinct().count() == 2
    assert raster.gaps(shapes, box, least_sqkm=50.0).isEmpty()
