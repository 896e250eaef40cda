"""Shapes as cells of a metric grid: whole ones inside, small ones only along the border."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.geo import in_ring
from .iterate import components, cut
from .spatial import areas_near

#: Side of the smallest cells in metres, and levels above them, each twice as wide.
FINE_M, TOP = 10.0, 7
#: Corner of the grid and metres a degree along both axes.
ORIGIN = (C.CITY["min_lat"] - 0.5, C.CITY["min_lon"] - 0.5)
LAT_M = C.METERS_PER_DEGREE
LON_M = C.METERS_PER_DEGREE * math.cos(math.radians((C.CITY["min_lat"] + C.CITY["max_lat"]) / 2))


def _flat(ring: Column) -> Column:
    """Corners in metres from the grid's corner, as structs (lat, lon)."""
    return F.transform(ring, lambda p: F.struct(((p["lat"] - ORIGIN[0]) * LAT_M).alias("lat"), ((p["lon"] - ORIGIN[1]) * LON_M).alias("lon")))


def _crosses(ring: Column, y0: Column, x0: Column, side: Column) -> Column:
    """Whether an edge of the ring meets the square: their boxes overlap, and not all corners lie on one side of the edge."""
    n = F.size(ring)
    nexts = F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, 1, 1))
    y1, x1 = y0 + side, x0 + side

    def meets(a: Column, b: Column) -> Column:
        boxes = (F.least(a.lat, b.lat) <= y1) & (F.greatest(a.lat, b.lat) >= y0) & (F.least(a.lon, b.lon) <= x1) & (F.greatest(a.lon, b.lon) >= x0)
        at = lambda y, x: (b.lon - a.lon) * (y - a.lat) - (b.lat - a.lat) * (x - a.lon)
        sides = [at(y, x) for y in (y0, y1) for x in (x0, x1)]
        return boxes & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    return F.exists(F.zip_with(ring, nexts, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda e: meets(e["a"], e["b"]))


def cover(polygons: DataFrame, fine: float = FINE_M, top: int = TOP) -> DataFrame:
    """level, row, col, area_key: polygons (area_key, box, ring) as cells of side fine * 2^level. A cell within is kept whole; one that the border
    crosses is split, down to the smallest, which count if their middle is inside. A map over polygons: nothing is shuffled."""
    meters = lambda c, i: (F.col(c) - ORIGIN[i]) * (LAT_M, LON_M)[i]
    wide = fine * 2**top
    span = lambda x, i: F.sequence(F.floor(meters(f"min_{x}", i) / wide), F.floor(meters(f"max_{x}", i) / wide))
    cells = polygons.select("area_key", _flat(F.col("ring")).alias("ring"), F.explode(span("lat", 0)).alias("row"), F.lit(top).alias("level"), span("lon", 1).alias("__c"))
    cells = cells.select("area_key", "ring", "level", "row", F.explode("__c").alias("col"), F.lit(False).alias("whole"))
    for level in range(top, -1, -1):
        side = F.lit(fine * 2**level)
        y, x = F.col("row") * side, F.col("col") * side
        inside = in_ring(y + side / 2, x + side / 2, F.col("ring"))
        border = _crosses(F.col("ring"), y, x, side) if level else F.lit(False)
        open_ = ~F.col("whole")
        # Cells that are settled stay as they are; of the others those outside go, and those on the border are split.
        cells = cells.withColumn("__border", open_ & border).filter(F.col("whole") | F.col("__border") | inside)
        if level:
            part = lambda r, c: F.struct(F.lit(level - 1).alias("level"), (F.col("row") * 2 + r).alias("row"), (F.col("col") * 2 + c).alias("col"), F.lit(False).alias("whole"))  # noqa: B023, E731
            own = F.array(F.struct("level", "row", "col", F.lit(True).alias("whole")))
            cells = cells.select("area_key", "ring", F.inline(F.when(F.col("__border"), F.array(*[part(r, c) for r in (0, 1) for c in (0, 1)])).otherwise(own)))
    return cells.select("level", "row", "col", "area_key")


def _within(probes: DataFrame, cells: DataFrame, top: int) -> DataFrame:
    """probes (row, col of the smallest cells, ...) with o_level, o_row, o_col, the cell of `cells` (level, row, col) that holds each; others go."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(top)))
    at = probes.withColumn("o_level", levels).withColumns({"o_row": F.expr("shiftright(row, o_level)"), "o_col": F.expr("shiftright(col, o_level)")})
    return at.join(cells.select(F.col("level").alias("o_level"), F.col("row").alias("o_row"), F.col("col").alias("o_col")).distinct(), ["o_level", "o_row", "o_col"])


def united(cells: DataFrame, top: int = TOP) -> DataFrame:
    """level, row, col of cells of several shapes, none of them inside another."""
    every = cells.select("level", "row", "col").distinct()
    above = every.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(top)))).withColumns({"up": F.col("level") + F.col("__k"), "r": F.expr("shiftright(row, __k)"), "c": F.expr("shiftright(col, __k)")})
    whole = every.select(F.col("level").alias("up"), F.col("row").alias("r"), F.col("col").alias("c"))
    inner = above.filter(F.col("up") <= top).join(whole, ["up", "r", "c"], "left_semi").select("level", "row", "col").distinct()
    return every.join(inner, ["level", "row", "col"], "left_anti")


def square_km(cells: DataFrame, fine: float = FINE_M) -> Column:
    """The sum of the areas of cells, for an aggregation."""
    return F.sum(F.pow(F.lit(4.0), F.col("level"))) * (fine * fine / 1e6)


def _rim(cells: DataFrame, outside: bool) -> DataFrame:
    """The smallest cells along the border of each cell, within it or around it, corners too: row, col and the cell's own level, row, col as f_*."""
    n = F.expr("CAST(shiftleft(1, f_level) AS BIGINT)")
    named = cells.select(*[F.col(c).alias(f"f_{c}") for c in ("level", "row", "col")])
    low, high = (F.lit(-1).cast("bigint"), n) if outside else (F.lit(0).cast("bigint"), n - 1)
    along = F.sequence(low, high)
    sides = F.array_distinct(F.flatten(F.transform(along, lambda k: F.array(*[F.struct(a.alias("r"), b.alias("c")) for a, b in ((low, k), (high, k), (k, low), (k, high))]))))
    rim = named.select("*", F.explode(sides).alias("__s"))
    return rim.select("f_level", "f_row", "f_col", (F.col("f_row") * n + F.col("__s.r")).alias("row"), (F.col("f_col") * n + F.col("__s.c")).alias("col"))


def _disk(meters: float, fine: float) -> Column:
    """Offsets to the smallest cells whose middles are within a distance."""
    n = int(meters // fine)
    return F.array(*[F.struct(F.lit(r).cast("bigint").alias("r"), F.lit(c).cast("bigint").alias("c")) for r in range(-n, n + 1) for c in range(-n, n + 1) if (r * r + c * c) * fine * fine <= meters * meters])


def closed_seams(cells: DataFrame, meters: float, fine: float = FINE_M, top: int = TOP) -> DataFrame:
    """level, row, col of a union of cells with the seams filled that vanish when it grows by a distance and shrinks again.

    Only what lies within the distance of a border is looked at: it is new if it is near the union, and stays if all that is as near to it is
    new or of the union. The union itself stays as it is."""
    own = cells.select("level", "row", "col")
    disk = F.explode(_disk(meters, fine))
    grown = _rim(own, False).select("row", "col").distinct().select(F.col("row"), F.col("col"), disk.alias("d")).select((F.col("row") + F.col("d.r")).alias("row"), (F.col("col") + F.col("d.c")).alias("col")).distinct()
    new = cut(grown.join(_within(grown, own, top).select("row", "col").distinct(), ["row", "col"], "left_anti"))
    around = new.select(F.col("row").alias("n_row"), F.col("col").alias("n_col"), disk.alias("d")).select("n_row", "n_col", (F.col("n_row") + F.col("d.r")).alias("row"), (F.col("n_col") + F.col("d.c")).alias("col"))
    spots = around.select("row", "col").distinct()
    held = _within(spots, own, top).select("row", "col").distinct().unionByName(new)
    free = around.join(held, ["row", "col"], "left_anti").select(F.col("n_row").alias("row"), F.col("n_col").alias("col")).distinct()
    stay = new.join(free, ["row", "col"], "left_anti")
    return own.unionByName(stay.select(F.lit(0).alias("level"), "row", "col"))


def _number(prefix: str = "") -> Column:
    return (F.col(f"{prefix}level").cast("bigint") * (1 << 25) + F.col(f"{prefix}row")) * (1 << 25) + F.col(f"{prefix}col")


def with_part(cells: DataFrame, top: int = TOP) -> DataFrame:
    """level, row, col and `part`, the least number of the cells that hang together with it, by sides or corners, whatever their sizes."""
    own = cut(cells.select("level", "row", "col").withColumn("id", _number()))
    links = _within(_rim(own, True), own, top).select(_number("f_").alias("a"), _number("o_").alias("b")).distinct()
    return own.join(components(own.select("id"), links), "id").select("level", "row", "col", F.col("component").alias("part"))


def gaps(polygons: DataFrame, box: dict[str, float], fine: float = 50.0, apart: float = 30.0, thick: float = 200.0, least_sqkm: float = C.LEAST_GAP_SQKM) -> DataFrame:
    """row, col, part: cells of a box that lie in no polygon nor within `apart` of one, in pieces that have the least area and somewhere
    hold a disk of radius `thick` (a strip must be twice as wide). Cells whose middle counts; the box is the city's, so cells are bounded."""
    rows, columns = ((math.floor((box[f"min_{x}"] - ORIGIN[i]) * m / fine), math.ceil((box[f"max_{x}"] - ORIGIN[i]) * m / fine) - 1) for i, (x, m) in enumerate((("lat", LAT_M), ("lon", LON_M))))
    spark = polygons.sparkSession
    grid = spark.range(rows[0], rows[1] + 1).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(columns[0]).cast("bigint"), F.lit(columns[1]).cast("bigint"))).alias("col"))
    spots = grid.select(F.struct("row", "col").alias("id"), ((F.col("row") + 0.5) * fine / LAT_M + ORIGIN[0]).alias("lat"), ((F.col("col") + 0.5) * fine / LON_M + ORIGIN[1]).alias("lon"))
    taken = areas_near(spots, polygons, apart, 1).select("id.row", "id.col")
    free = cut(grid.join(taken, ["row", "col"], "left_anti"))
    offsets = _disk(thick, fine)
    near = free.select(F.col("row").alias("n_row"), F.col("col").alias("n_col"), F.explode(offsets).alias("d")).select("n_row", "n_col", (F.col("n_row") + F.col("d.r")).alias("row"), (F.col("n_col") + F.col("d.c")).alias("col"))
    cores = near.join(free, ["row", "col"]).groupBy("n_row", "n_col").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.size(offsets)).select(F.col("n_row").alias("row"), F.col("n_col").alias("col"))
    parts = cut(with_part(free.withColumn("level", F.lit(0)), 0))
    large = parts.groupBy("part").agg((F.count(F.lit(1)) * (fine * fine / 1e6)).alias("sqkm")).filter(F.col("sqkm") >= least_sqkm)
    thickest = parts.join(cores, ["row", "col"], "left_semi").select("part").distinct()
    return parts.join(large, "part", "left_semi").join(thickest, "part", "left_semi").select("row", "col", "part")
