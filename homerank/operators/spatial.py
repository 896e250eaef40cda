"""Spatial joins: each is an equality join on grid cells with an exact test after it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.geo import cell, flat_manhattan_m, in_ring, manhattan_m
from .iterate import components

#: Side of the cells into which polygons are cut, in degrees.
POLYGON_CELL = 0.02
#: Views whose boxes and cells go to every task; more of them are dealt with the points by their key.
FEW_VIEWS = 2_000
#: Cells that the distance of a radius join spans each way.
RADIUS_CELLS = 4
#: Places in a cell, about, where the search for the nearest one begins; the least and the widest cell in degrees, the latter spans the city.
CELL_PLACES, LEAST_CELL, WIDEST_CELL = 2, 0.001, 1.28
#: Up to so many places wait in cells that Spark may broadcast, nine times each and at every level; up to so many go to the tasks once, as
#: arrays (24 bytes a place and its key); with more, places and points are dealt by cell.
FEW_PLACES, MOST_PLACES = 10_000, 2_000_000
#: How many places a task holds against its points at a time.
HELD = 1_000_000


def _cover(polygons: DataFrame, degrees: float) -> DataFrame:
    """A row for each cell that a polygon's box touches."""
    rows = F.sequence(cell(F.col("min_lat"), degrees), cell(F.col("max_lat"), degrees))
    columns = F.sequence(cell(F.col("min_lon"), degrees), cell(F.col("max_lon"), degrees))
    return polygons.withColumn("__cr", F.explode(rows)).withColumn("__cc", F.explode(columns))


def with_polygons(points: DataFrame, polygons: DataFrame, name: str = "inside_keys", degrees: float = POLYGON_CELL) -> DataFrame:
    """points (lat, lon) with an array of the keys of all polygons (area_key, ord, box, ring) that contain each, in list order.

    One equality join on cells, whose polygons wait in an array, so the points are neither shuffled nor repeated while the
    layer is small enough for Spark to broadcast it. A cell's array holds the few polygons that touch it.
    """
    near = _cover(polygons.select("area_key", "ord", "min_lat", "max_lat", "min_lon", "max_lon", "ring"), degrees)
    near = near.groupBy("__cr", "__cc").agg(F.array_sort(F.collect_list(F.struct("ord", "area_key", "min_lat", "max_lat", "min_lon", "max_lon", "ring"))).alias("__near"))
    placed = points.withColumn("__cr", cell(F.col("lat"), degrees)).withColumn("__cc", cell(F.col("lon"), degrees)).join(near, ["__cr", "__cc"], "left")
    inside = lambda p: F.col("lat").between(p.min_lat, p.max_lat) & F.col("lon").between(p.min_lon, p.max_lon) & in_ring(F.col("lat"), F.col("lon"), p.ring)
    keys = F.transform(F.filter("__near", inside), lambda p: p.area_key)
    return placed.withColumn(name, F.coalesce(keys, F.array().cast("array<string>"))).drop("__cr", "__cc", "__near")


def first_polygon(points: DataFrame, polygons: DataFrame, id_col: str = "id") -> DataFrame:
    """id_col, area_key: the first polygon in list order that contains each point, null outside all."""
    return with_polygons(points.select(id_col, "lat", "lon"), polygons).select(id_col, F.try_element_at("inside_keys", F.lit(1)).alias("area_key"))


def within_any(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """The points inside at least one polygon."""
    return with_polygons(points, polygons, "__inside").filter(F.size("__inside") > 0).drop("__inside")


def within_radius(points: DataFrame, places: DataFrame, meters: float, id_col: str = "id", place_col: str = "station_id") -> DataFrame:
    """id_col, place_col, meters: all places within a grid distance of each point.

    A place is dealt to the cells, a share of the distance wide, that some point within the distance may lie in, so most pairs that
    meet in a cell are results. Both sides are dealt and sorted by cell: a cell's places stay at hand for all its points, nothing is
    broadcast, and many tasks share the pairs.
    """
    rows, columns = meters / C.METERS_PER_DEGREE / RADIUS_CELLS, meters / _least_meters(C.CITY["max_lat"]) / RADIUS_CELLS
    left = points.select(id_col, "lat", "lon", _cell_key(cell(F.col("lat"), rows), cell(F.col("lon"), columns)).alias("__cell"))
    right = _reached(places.select(place_col, F.col("lat").alias("__lat"), F.col("lon").alias("__lon")), meters, rows, columns)
    d = manhattan_m(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon"))
    tasks = even_tasks(points)
    return left.repartition(tasks, "__cell").join(right.repartition(tasks, "__cell").hint("merge"), "__cell").filter(d <= meters).select(id_col, place_col, d.alias("meters"))


def even_tasks(df: DataFrame) -> int:
    """A count of tasks for work that grows with what a task gives, not with the bytes it reads, by which Spark would merge them."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _least_meters(lat: float) -> float:
    """Meters of a degree of longitude, at least, up to one degree north of a latitude."""
    return C.METERS_PER_DEGREE * math.cos(math.radians(abs(lat) + 1))


def _cell_key(row: Column, column: Column) -> Column:
    return row * (1 << 32) + column


def _reached(places: DataFrame, meters: float, rows: float, columns: float) -> DataFrame:
    """places (__lat, __lon) once for each cell (__cell) of a grid that a diamond of `meters` around them touches."""
    far = meters * (1 + 1e-6) / C.METERS_PER_DEGREE  # a hair more than the distance, so rounding loses no cell
    banded = places.withColumn("__row", F.explode(F.sequence(cell(F.col("__lat") - far, rows), cell(F.col("__lat") + far, rows))))
    gap = F.greatest(F.lit(0.0), F.col("__row") * rows - F.col("__lat"), F.col("__lat") - (F.col("__row") + 1) * rows)
    # The mean latitude of a pair is within half the distance of the place, where a degree of longitude is narrowest.
    half = F.greatest(F.lit(0.0), far - gap) / F.cos(F.radians(F.least(F.abs("__lat") + far, F.lit(89.9))))
    across = F.sequence(cell(F.col("__lon") - half, columns), cell(F.col("__lon") + half, columns))
    return banded.withColumn("__column", F.explode(across)).withColumn("__cell", _cell_key(F.col("__row"), F.col("__column"))).drop("__row", "__column")


def _neighbours(places: DataFrame, degrees: float) -> DataFrame:
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    return places.withColumn("__dr", F.explode(near)).withColumn("__dc", F.explode(near)).withColumn("__cr", cell(F.col("__lat"), degrees) + F.col("__dr")).withColumn("__cc", cell(F.col("__lon"), degrees) + F.col("__dc")).drop("__dr", "__dc")


def _closest(points: DataFrame, places: DataFrame, key: Column, metric, flat, sure_share: float, name: str, few: int = FEW_PLACES, most: int = MOST_PLACES) -> DataFrame:
    """points with a struct `name` (d, key): the nearest place (lat, lon), by metric(lat1, lon1, lat2, lon2) and then by key; null without places.

    A point meets the places of its cell and the eight around it, which wait in an array; a find is final when it is nearer
    than sure_share of a cell's width. Others look again in cells four times as wide, up to the whole city: a chain of
    left joins in which every level stands once and no point is shuffled while the places are few. More than `few` places go to the tasks as
    arrays, which search them alike (flat: the metric over arrays); only with more than `most` the points are dealt by cell.
    The first cells are so wide that each holds a few places; points that are done, or lie outside, spread over keys without places.
    """
    spots = places.select(F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), key.alias("__key"))
    extent = (C.CITY["max_lat"] - C.CITY["min_lat"]) * (C.CITY["max_lon"] - C.CITY["min_lon"])
    count = places.count()
    degrees = min(max(math.sqrt(extent * CELL_PLACES / max(count, 1)), LEAST_CELL), WIDEST_CELL)
    kind = f"struct<d:double,key:{spots.schema['__key'].dataType.simpleString()}>"
    if few < count <= most:
        return points.withColumn(name, _from_arrays(spots, flat, sure_share, degrees, kind)(F.col("lat").cast("double"), F.col("lon").cast("double")))
    rows, done = points.withColumn(name, F.lit(None).cast(kind)), F.lit(False)
    away = -1 - F.pmod(F.xxhash64("lat", "lon"), F.lit(1 << 40)) - (1 << 20)
    last = False
    while not last:
        last = degrees >= WIDEST_CELL
        near = _neighbours(spots, degrees).groupBy("__cr", "__cc").agg(F.collect_list(F.struct("__lat", "__lon", "__key")).alias("__near"))
        near = near.hint("merge") if count > few else near  # Spark takes them for as small as the file that they come from
        rows = rows.withColumn("__cr", F.when(~done, cell(F.col("lat"), degrees)).otherwise(away)).withColumn("__cc", cell(F.col("lon"), degrees)).join(near, ["__cr", "__cc"], "left")
        found = F.array_min(F.transform("__near", lambda p: F.struct(metric(F.col("lat"), F.col("lon"), p["__lat"], p["__lon"]).alias("d"), p["__key"].alias("key"))))
        rows = rows.withColumn(name, F.coalesce(found, name)).drop("__cr", "__cc", "__near")
        done = F.coalesce(F.col(name).getField("d") <= degrees * sure_share, F.lit(False))
        degrees = min(4 * degrees, WIDEST_CELL)
    return rows


def _from_arrays(spots: DataFrame, flat, sure_share: float, degrees: float, kind: str) -> Callable[[Column, Column], Column]:
    """What _closest finds, by one sorted list of places a level in each task: the nine cells of a point are three runs of it."""
    table = spots.filter("__lat IS NOT NULL AND __lon IS NOT NULL").orderBy("__key").toArrow()  # at most MOST_PLACES rows
    sent = spots.sparkSession.sparkContext.broadcast((table["__lat"].to_numpy(), table["__lon"].to_numpy(), table["__key"].combine_chunks()))

    def number(row: np.ndarray, column: np.ndarray) -> np.ndarray:
        return row * (1 << 32) + column

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        lats, lons, keys = sent.value
        levels, wide = [], degrees
        while True:
            cells = number(np.floor(lats / wide).astype("int64"), np.floor(lons / wide).astype("int64"))
            order = np.argsort(cells, kind="stable")
            levels.append((wide, cells[order], order))
            if wide >= WIDEST_CELL:
                break
            wide = min(4 * wide, WIDEST_CELL)
        for batch in batches:
            lat, lon = (x.to_numpy(zero_copy_only=False) for x in batch)
            best, which = np.full(len(lat), np.inf), np.full(len(lat), -1)
            todo = np.flatnonzero((np.abs(lat) < 1e5) & (np.abs(lon) < 1e5))  # not null, not beyond all cells
            for wide, cells, order in levels:
                row, column = np.floor(lat[todo] / wide).astype("int64"), np.floor(lon[todo] / wide).astype("int64")
                low = np.stack([np.searchsorted(cells, number(row + i, column - 1), "left") for i in (-1, 0, 1)], 1)
                size = np.stack([np.searchsorted(cells, number(row + i, column + 1), "right") for i in (-1, 0, 1)], 1) - low
                held = size.sum(1)
                some = np.flatnonzero(held)
                for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(held[some]) // HELD)) + 1):
                    if len(part):
                        runs, each = size[part].ravel(), held[part]
                        starts = np.cumsum(runs) - runs
                        met = order[np.arange(runs.sum()) + np.repeat(low[part].ravel() - starts, runs)]
                        point, begin = np.repeat(todo[part], each), np.cumsum(each) - each
                        d = flat(lat[point], lon[point], lats[met], lons[met])
                        least = np.minimum.reduceat(d, begin)
                        best[todo[part]] = least
                        which[todo[part]] = np.minimum.reduceat(np.where(d == np.repeat(least, each), met, len(lats)), begin)
                todo = todo[best[todo] > wide * sure_share]
            found = which >= 0
            none = pa.array(~found)
            taken = keys.take(pa.array(np.maximum(which, 0))) if len(keys) else pa.nulls(len(lat), keys.type)
            yield pa.StructArray.from_arrays([pa.array(best), taken], names=["d", "key"], mask=none)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def with_nearest(points: DataFrame, places: DataFrame, place_col: str = "station_id", meters: str = "meters", key: str | None = None, few: int = FEW_PLACES, most: int = MOST_PLACES) -> DataFrame:
    """points with place_col and meters: the nearest place by grid distance, the smaller id (column key, else place_col) of equal ones."""
    sure = C.METERS_PER_DEGREE * math.cos(math.radians(C.CITY["max_lat"] + 1))
    out = _closest(points, places, F.col(key or place_col), manhattan_m, flat_manhattan_m(), sure, "__best", few, most)
    return out.withColumn(place_col, F.col("__best.key")).withColumn(meters, F.col("__best.d")).drop("__best")


def nearest(points: DataFrame, places: DataFrame, id_col: str = "id", place_col: str = "station_id") -> DataFrame:
    """id_col, place_col, meters of each point that has a nearest place."""
    return with_nearest(points.select(id_col, "lat", "lon"), places, place_col).filter("meters IS NOT NULL").select(id_col, place_col, "meters")


def nearest_anchor(points: DataFrame, polygons: DataFrame, id_col: str = "id") -> DataFrame:
    """id_col, area_key: the area whose centre is nearest in plain degrees, the earlier of equal ones."""
    places = polygons.select("area_key", "ord", F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon"))
    plain = lambda a, b, c, d: F.sqrt(F.pow(a - c, 2) + F.pow(b - d, 2))
    out = _closest(points.select(id_col, "lat", "lon"), places, F.struct("ord", "area_key"), plain, lambda a, b, c, d: np.sqrt((a - c) ** 2 + (b - d) ** 2), 1.0, "__best")
    return out.select(id_col, F.col("__best.key.area_key").alias("area_key"))


def clusters(points: DataFrame, boxes: DataFrame, key: str = "search_id", rows: int = 3, columns: int = 4) -> DataFrame:
    """points (key, id, lat, lon) in the viewports of boxes (key, min_lat, max_lat, min_lon, max_lon) with row and col of a grid over each; edges belong to the edge cells."""
    inside = points.join(boxes, key).filter(F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon")))
    at = lambda x, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(x) - F.col(f"min_{x}")) / _span(x) * n)))
    return inside.withColumn("row", at("lat", rows)).withColumn("col", at("lon", columns))


def _span(x: str) -> Column:
    return F.greatest(F.col(f"max_{x}") - F.col(f"min_{x}"), F.lit(1e-9))


def clusters_and_pins(points: DataFrame, boxes: DataFrame, zooms: DataFrame, key: str = "search_id", rows: int = 3, columns: int = 4, open_rows: int = C.OPEN_CELL_ROWS, most: int = C.MOST_PINS) -> DataFrame:
    """key, kind, id, row, col, n, lat, lon and a cell's bounds: what a map shows of points (key, id, lat, lon).

    Cells open into pins (kind 'pin', with id), the smallest first, while each has at most open_rows points (any number from
    the zoom in zooms (key, zoom) on at which all cells open) and the pins stay within `most`; as the counts ascend, the open
    cells are a prefix. Other cells are one badge at the middle of their points. A key without a box shows its first `most` ids.
    """
    few = boxes.limit(FEW_VIEWS + 1).count() <= FEW_VIEWS
    sent = F.broadcast if few else lambda df: df
    dealt = clusters(points, sent(boxes), key, rows, columns)
    cells = dealt.groupBy(key, "row", "col").agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), *[F.first(c).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])
    before = Window.partitionBy(key).orderBy("n", "row", "col").rowsBetween(Window.unboundedPreceding, 0)  # at most rows * columns cells of a key
    cells = cells.join(zooms.select(key, "zoom"), key, "left").withColumn("open", ((F.col("n") <= open_rows) | F.coalesce(F.col("zoom") >= C.OPEN_ZOOM, F.lit(False))) & (F.sum("n").over(before) <= most))
    bound = lambda x, i, n: F.col(f"min_{x}") + i * _span(x) / n
    none = F.lit(None)
    badges = cells.filter("NOT open").select(
        key, F.lit("cluster").alias("kind"), none.cast(points.schema["id"].dataType).alias("id"), "row", "col", "n", "lat", "lon",
        bound("lat", F.col("row"), rows).alias("south"), bound("lat", F.col("row") + 1, rows).alias("north"), bound("lon", F.col("col"), columns).alias("west"), bound("lon", F.col("col") + 1, columns).alias("east"),
    )
    bare = [none.cast("double").alias(c) for c in ("south", "north", "west", "east")]
    pins = dealt.join(sent(cells.filter("open").select(key, "row", "col")), [key, "row", "col"]).select(key, F.lit("pin").alias("kind"), "id", "row", "col", F.lit(1).cast("bigint").alias("n"), "lat", "lon", *bare)
    first = F.row_number().over(Window.partitionBy(key).orderBy("id"))
    loose = points.join(sent(boxes.select(key)), key, "left_anti").withColumn("__r", first).filter(F.col("__r") <= most)
    loose = loose.select(key, F.lit("pin").alias("kind"), "id", none.cast("bigint").alias("row"), none.cast("bigint").alias("col"), F.lit(1).cast("bigint").alias("n"), "lat", "lon", *bare)
    return badges.unionByName(pins).unionByName(loose)


def _next_corners(ring: Column) -> Column:
    return F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1))


def ring_distance(lat: Column, lon: Column, ring: Column) -> Column:
    """Meters from a point to a ring in a flat projection at the point; 0 inside."""
    scale = F.cos(F.radians(lat)) * C.METERS_PER_DEGREE

    def edge(a: Column, b: Column) -> Column:
        ax, ay, bx, by = (a.lon - lon) * scale, (a.lat - lat) * C.METERS_PER_DEGREE, (b.lon - lon) * scale, (b.lat - lat) * C.METERS_PER_DEGREE
        dx, dy = bx - ax, by - ay
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))))
        return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))

    return F.when(in_ring(lat, lon, ring), 0.0).otherwise(F.array_min(F.zip_with(ring, _next_corners(ring), edge)))


def _rings_cross(a: Column, b: Column) -> Column:
    """Whether some edge of one ring crosses some edge of the other."""
    edges = lambda ring: F.zip_with(ring, _next_corners(ring), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    side = lambda p, q, r: F.signum((q.lon - p.lon) * (r.lat - p.lat) - (q.lat - p.lat) * (r.lon - p.lon))
    crossed = lambda e, f: (side(e.p, e.q, f.p) * side(e.p, e.q, f.q) < 0) & (side(f.p, f.q, e.p) * side(f.p, f.q, e.q) < 0)
    return F.exists(edges(a), lambda e: F.exists(edges(b), lambda f: crossed(e, f)))


def same_name_places(polygons: DataFrame, meters: float = C.SAME_PLACE_M) -> DataFrame:
    """id, name, place of polygons (id, name, box, ring): those of one name within a distance of each other are one place, named by its least id.

    Polygons meet by name in the cells that their boxes, widened by half the distance, touch. Two that do not overlap are nearest at
    a corner of one of them; two that do have a corner inside or edges that cross.
    """
    lat_pad, lon_pad = meters / 2 / C.METERS_PER_DEGREE, meters / 2 / (C.METERS_PER_DEGREE * math.cos(math.radians(C.CITY["max_lat"] + 1)))
    wide = polygons.select("id", "name", "ring", *[(F.col(f"min_{x}") - p).alias(f"min_{x}") for x, p in (("lat", lat_pad), ("lon", lon_pad))], *[(F.col(f"max_{x}") + p).alias(f"max_{x}") for x, p in (("lat", lat_pad), ("lon", lon_pad))])
    dealt = _cover(wide, POLYGON_CELL)
    other = dealt.select("name", "__cr", "__cc", F.col("id").alias("__id"), F.col("ring").alias("__ring"), *[F.col(f"{m}_{x}").alias(f"__{m}_{x}") for m in ("min", "max") for x in ("lat", "lon")])
    met = dealt.join(other, ["name", "__cr", "__cc"]).filter("id < __id AND min_lat <= __max_lat AND __min_lat <= max_lat AND min_lon <= __max_lon AND __min_lon <= max_lon")
    a, b = F.col("ring"), F.col("__ring")
    close = F.exists(a, lambda c: ring_distance(c.lat, c.lon, b) <= meters) | F.exists(b, lambda c: ring_distance(c.lat, c.lon, a) <= meters) | _rings_cross(a, b)
    links = met.filter(close).select(F.col("id").alias("a"), F.col("__id").alias("b")).distinct()
    return polygons.select("id", "name").join(components(polygons.select("id"), links).withColumnRenamed("component", "place"), "id")


def areas_near(points: DataFrame, polygons: DataFrame, meters: float = C.AREA_NEAR_M, most: int = C.AREAS_NEAR, id_col: str = "id") -> DataFrame:
    """id_col, area_key, meters, rank: up to `most` areas within a distance of each point, nearest first, equal ones by key; 0 inside.

    Distance to the ring in a flat projection at the point. Polygons wait in the cells that their box, widened by the
    distance, touches.
    """
    lat_pad, lon_pad = meters / C.METERS_PER_DEGREE, meters / (C.METERS_PER_DEGREE * math.cos(math.radians(C.CITY["max_lat"] + 1)))
    wide = polygons.select("area_key", "ord", "ring", *[(F.col(f"min_{x}") - p).alias(f"min_{x}") for x, p in (("lat", lat_pad), ("lon", lon_pad))], *[(F.col(f"max_{x}") + p).alias(f"max_{x}") for x, p in (("lat", lat_pad), ("lon", lon_pad))])
    pairs = points.select(id_col, "lat", "lon").withColumn("__cr", cell(F.col("lat"), POLYGON_CELL)).withColumn("__cc", cell(F.col("lon"), POLYGON_CELL)).join(_cover(wide, POLYGON_CELL), ["__cr", "__cc"])
    found = pairs.withColumn("meters", ring_distance(F.col("lat"), F.col("lon"), F.col("ring"))).filter(F.col("meters") <= meters)
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("meters", "area_key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most).select(id_col, "area_key", "meters", "rank")


def covered_cells(polygons: DataFrame, degrees: float) -> DataFrame:
    """row, col, area_key: cells of a grid whose middle lies in a polygon."""
    spots = _cover(polygons.select("area_key", "ord", "min_lat", "max_lat", "min_lon", "max_lon", "ring"), degrees)
    lat, lon = (F.col("__cr") + 0.5) * degrees, (F.col("__cc") + 0.5) * degrees
    return spots.filter(in_ring(lat, lon, F.col("ring"))).select(F.col("__cr").alias("row"), F.col("__cc").alias("col"), "area_key")


def around(cells: DataFrame) -> DataFrame:
    """Each cell (row, col) with itself and its eight neighbours: row, col, from_row, from_col."""
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    return cells.withColumn("__r", F.explode(near)).withColumn("__c", F.explode(near)).select((F.col("row") + F.col("__r")).alias("row"), (F.col("col") + F.col("__c")).alias("col"), F.col("row").alias("from_row"), F.col("col").alias("from_col"))


def closed(cells: DataFrame) -> DataFrame:
    """Cells with the seams between them filled: dilated by one cell, then eroded by one."""
    wide = around(cells.select("row", "col").distinct()).select("row", "col").distinct()
    inner = around(wide).join(wide, ["row", "col"]).groupBy("from_row", "from_col").agg(F.count(F.lit(1)).alias("n")).filter("n = 9")
    return inner.select(F.col("from_row").alias("row"), F.col("from_col").alias("col"))


def with_part(cells: DataFrame) -> DataFrame:
    """cells (row, col) with `part`: the least cell number of the connected group, sides and corners counting."""
    number = lambda r, c: F.col(r) * (1 << 20) + F.col(c)
    links = around(cells).join(cells.select("row", "col"), ["row", "col"]).select(number("row", "col").alias("a"), number("from_row", "from_col").alias("b"))
    parts = components(cells.select(number("row", "col").alias("id")), links)
    return cells.withColumn("id", number("row", "col")).join(parts, "id").select("row", "col", F.col("component").alias("part"))


def areas_by_key(asked: DataFrame, areas: DataFrame, most: int = C.MOST_AREA_KEYS) -> DataFrame:
    """Rows of areas for the first `most` keys of each request (request, pos, area_key), in order by pos; unknown keys are dropped."""
    first = F.row_number().over(Window.partitionBy("request").orderBy("pos"))
    return asked.withColumn("__r", first).filter(F.col("__r") <= most).drop("__r").join(areas, "area_key")


_FEATURE = "struct<properties:struct<key:string,ord:bigint,title:string,keywords:string>,geometry:struct<coordinates:array<array<array<double>>>>>"


def read_areas(files: DataFrame) -> DataFrame:
    """area_key, ord, title, keywords, ring of feature collections (file, raw JSON): of areas with one key the one of the first file, and there the first, counts."""
    each = files.select("file", F.posexplode(F.from_json("raw", f"struct<features:array<{_FEATURE}>>").features).alias("pos", "f"))
    rows = each.select("file", "pos", F.col("f.properties.key").alias("area_key"), F.col("f.properties.ord").alias("ord"), F.col("f.properties.title").alias("title"), F.filter(F.transform(F.split("f.properties.keywords", "[،,؛;/|\\n]+"), lambda k: F.trim(k)), lambda k: k != "").alias("keywords"), F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon"))).alias("ring"))
    first = rows.groupBy("area_key").agg(F.min_by(F.struct("ord", "title", "keywords", "ring"), F.struct("file", "pos")).alias("r"))
    return first.select("area_key", "r.*")


def largest(polygons: DataFrame) -> DataFrame:
    """The one polygon (key, ring) with the largest area."""
    n = F.size("ring")
    cross = F.zip_with("ring", F.concat(F.slice("ring", F.lit(2), n - 1), F.slice("ring", 1, 1)), lambda a, b: a.lon * b.lat - b.lon * a.lat)
    return polygons.withColumn("__a", F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x))).orderBy(F.desc("__a"), "key").limit(1).drop("__a")
