"""The transit network as tables, and travel times over it for many origins at once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.geo import cell, haversine_km, in_box, manhattan_m
from .iterate import components, cut, cut_packed
from .spatial import FEW_PLACES, even_tasks, nearest, with_nearest, within_radius

#: Up to so many states that improved in a round are sent to every task: some 50 bytes each.
FEW_FRESH = 500_000
#: Networks of up to so many moves go to every task, which takes a block of origins hop by hop; in larger ones every hop is a join.
MOST_MOVES = 5_000_000
#: How many values of states times origins a task holds at a time, and the most origins of a block; how many moves are taken at a time.
BLOCK_VALUES, BLOCK, HELD_MOVES = 2_000_000, 256, 1_000_000


def station_lines(stations: DataFrame) -> DataFrame:
    """station_id, line; a station without one has a line of its own."""
    each = stations.select("station_id", F.explode_outer(F.array_compact(F.array("line", "second_line"))).alias("line"))
    return each.select("station_id", F.coalesce("line", F.concat(F.lit("_"), F.col("station_id").cast("string"))).alias("line")).distinct()


def symmetric(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: links between known nodes, both ways, no loops."""
    known = nodes.select("station_id")
    inner = links.filter("a <> b").join(known.select(F.col("station_id").alias("a")), "a", "left_semi").join(known.select(F.col("station_id").alias("b")), "b", "left_semi")
    return inner.select("a", "b").union(inner.select("b", "a")).distinct()


def route_adjacency(routes: DataFrame, order: str = "station_id") -> DataFrame:
    """a, b: consecutive stops of a line, both ways."""
    after = F.lead("station_id").over(Window.partitionBy("line").orderBy(order))
    steps = routes.select(F.col("station_id").alias("a"), after.alias("b")).filter("b IS NOT NULL AND a <> b")
    return steps.select("a", "b").union(steps.select("b", "a")).distinct()


def _pairs(stations: DataFrame, meters: float) -> DataFrame:
    found = within_radius(stations.select(F.col("station_id").alias("a"), "lat", "lon"), stations, meters, "a")
    return found.select("a", F.col("station_id").alias("b"), "meters").filter("a <> b")


def walk_transfers(stations: DataFrame, lines: DataFrame) -> DataFrame:
    """a, b, minutes: stations within a transfer's walk that share no line."""
    own = lines.groupBy("station_id").agg(F.collect_set("line").alias("lines"))
    pairs = _pairs(stations, C.TRANSFER_WALK_M).join(_dealt(own.select(F.col("station_id").alias("a"), F.col("lines").alias("__la")), stations), "a").join(_dealt(own.select(F.col("station_id").alias("b"), F.col("lines").alias("__lb")), stations), "b")
    return pairs.filter(~F.arrays_overlap("__la", "__lb")).select("a", "b", (F.col("meters") / C.WALK_M_PER_MIN).alias("minutes"))


def _dealt(side: DataFrame, stations: DataFrame) -> DataFrame:
    """side as a join takes it: Spark goes by the size of the packed file, by which a large network would be sent to every task, many times over."""
    return side.hint("merge") if stations.count() > FEW_PLACES else side


def stop_merge(stations: DataFrame) -> DataFrame:
    """station_id, stop: stations joined by steps of a stop's width are one stop, named by its least id."""
    return components(stations.select(F.col("station_id").alias("id")), _pairs(stations, C.STOP_MERGE_M)).select(F.col("id").alias("station_id"), F.col("component").alias("stop"))


def wait_minutes(kind: Column, line: Column) -> Column:
    by_line = F.create_map(*[F.lit(x) for kv in C.METRO_WAIT_BY_LINE.items() for x in kv])
    return F.when(kind == "brt", C.BRT_WAIT).otherwise(F.coalesce(F.try_element_at(by_line, line), F.lit(C.METRO_WAIT)))


def state_edges(stations: DataFrame, lines: DataFrame, adjacency: DataFrame, walks: DataFrame) -> DataFrame:
    """station_id, line, to_station, to_line, minutes: riding on, changing line in place and walking over."""
    kinds = stations.select("station_id", "type")
    many = stations.count() > FEW_PLACES
    dealt = lambda side: side.hint("merge") if many else side  # noqa: E731  # see _dealt
    at = lines.join(dealt(kinds), "station_id")
    to = dealt(lines.select(F.col("station_id").alias("to_station"), F.col("line").alias("to_line")).join(dealt(kinds.select(F.col("station_id").alias("to_station"), F.col("type").alias("to_type"))), "to_station"))
    wait = wait_minutes(F.col("to_type"), F.col("to_line"))
    step = dealt(adjacency.select(F.col("a").alias("station_id"), F.col("b").alias("to_station")))
    ride = at.join(step, "station_id").join(to, "to_station").filter("line = to_line").withColumn("minutes", F.when(F.col("type") == "brt", C.RIDE_MINS["brt"]).otherwise(C.RIDE_MINS["metro"]))
    change = at.join(to, F.col("station_id") == F.col("to_station")).filter("line <> to_line").withColumn("minutes", F.when(F.col("type") == "metro", C.METRO_CHANGE).otherwise(0.0) + wait)
    over = dealt(walks.select(F.col("a").alias("station_id"), F.col("b").alias("to_station"), F.col("minutes").alias("walk")))
    walk = at.join(over, "station_id").join(to, "to_station").withColumn("minutes", F.col("walk") + wait)
    names = ["station_id", "line", "to_station", "to_line"]
    every = ride.select(*names, "minutes").unionByName(change.select(*names, "minutes")).unionByName(walk.select(*names, "minutes"))
    return every.groupBy(*names).agg(F.min("minutes").alias("minutes"))


def reachable_stations(points: DataFrame, stations: DataFrame, id_col: str) -> DataFrame:
    """id_col, station_id, walk (minutes): all stations within an access walk, else the nearest one."""
    near = cut(within_radius(points, stations, C.ACCESS_WALK_M, id_col))
    rest = cut(points.select(id_col, "lat", "lon").join(near.select(id_col), id_col, "left_anti"))
    far = nearest(rest, stations, id_col)
    return near.unionByName(far.select(id_col, "station_id", "meters")).select(id_col, "station_id", (F.col("meters") / C.WALK_M_PER_MIN).alias("walk"))


def on_grid(x: Column) -> Column:
    """Origins are shared when they agree to four places."""
    return F.bround(x * 10_000) / 10_000


def arrival_times(origins: DataFrame, stations: DataFrame, lines: DataFrame, edges: DataFrame, within: float | None = None, most_moves: int = MOST_MOVES) -> DataFrame:
    """origin_id, station_id, minutes from each origin (origin_id, lat, lon) to the platform of every station it reaches; with `within` in less minutes than that.

    A network of up to most_moves moves goes to all tasks: each takes a block of origins, and no state is shuffled or written. A larger one is
    joined, all origins at once.
    """
    placed = origins.select("origin_id", on_grid(F.col("lat")).alias("lat"), on_grid(F.col("lon")).alias("lon"))
    boards = reachable_stations(placed, stations, "origin_id").join(_dealt(lines, stations), "station_id").join(_dealt(stations.select("station_id", "type"), stations), "station_id")
    boards = boards.select("origin_id", "station_id", "line", (F.col("walk") + wait_minutes(F.col("type"), F.col("line"))).alias("minutes"))
    if within is not None:
        boards = boards.filter(F.col("minutes") < within)
    edges = cut_packed(edges)
    if edges.count() <= most_moves:
        return _times_by_blocks(cut(boards), edges, lines, within)
    return _times_by_joins(cut(boards), edges, within)


def _times_by_blocks(boards: DataFrame, edges: DataFrame, states: DataFrame, within: float | None) -> DataFrame:
    """Origins by blocks, a column each. States are numbered; what was reached in less than the shortest move more than the earliest
    open state is final and moves on, once, all columns together."""
    spark, kinds = boards.sparkSession, {f.name: f.dataType.simpleString() for f in boards.schema}
    every = states.select("station_id", "line").union(edges.select("station_id", "line")).union(edges.select("to_station", "to_line")).distinct().orderBy("station_id", "line").toArrow()  # not more than moves and stations
    numbered = spark.createDataFrame(every.append_column("state", pa.array(np.arange(every.num_rows, dtype="int32"))))
    to = numbered.select(F.col("station_id").alias("to_station"), F.col("line").alias("to_line"), F.col("state").alias("end"))
    moves = edges.join(numbered, ["station_id", "line"]).join(to, ["to_station", "to_line"]).select("state", "end", "minutes").toArrow()  # at most MOST_MOVES rows of 16 bytes
    begin = moves["state"].to_numpy()
    order = np.argsort(begin, kind="stable")
    stations = every["station_id"].to_numpy()
    first = np.searchsorted(begin[order], np.arange(every.num_rows + 1))
    net = spark.sparkContext.broadcast((stations, first, moves["end"].to_numpy()[order], moves["minutes"].to_numpy()[order]))
    at = min(max(BLOCK_VALUES // max(every.num_rows, 1), 1), BLOCK)
    asked, tasks, held = boards.select("origin_id").distinct().count(), even_tasks(boards), HELD_MOVES
    block = F.pmod(F.xxhash64("origin_id"), F.lit(max(asked // at, min(asked, 4 * tasks), 1)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        stations, first, end, more = net.value
        platforms = np.flatnonzero(np.r_[True, stations[1:] != stations[:-1]])
        step = max(more.min(initial=np.inf), 0.5)  # minutes; shorter moves only mean that a state may move on again
        column, names = pd.factorize(rows["origin_id"])
        here, start = rows["state"].to_numpy().astype("int64"), rows["minutes"].to_numpy()
        out = []
        for low in range(0, len(names), at):
            mine, wide = (column >= low) & (column < low + at), min(at, len(names) - low)
            best, open_ = np.full(len(stations) * wide, np.inf), np.zeros(len(stations) * wide, bool)
            np.minimum.at(best, here[mine] * wide + column[mine] - low, start[mine])
            open_[here[mine] * wide + column[mine] - low] = True
            waiting = np.flatnonzero(open_)
            while len(waiting):
                due = best[waiting]
                now = waiting[due < due.min() + step]
                open_[now] = False
                size = first[now // wide + 1] - first[now // wide]
                for part in np.split(np.arange(len(now)), np.flatnonzero(np.diff(np.cumsum(size) // held)) + 1):
                    state, each = now[part], size[part]
                    move = np.arange(each.sum()) + np.repeat(first[state // wide] - np.cumsum(each) + each, each)
                    place = end[move].astype("int64") * wide + np.repeat(state % wide, each)
                    found = np.repeat(best[state], each) + more[move]
                    better = found < best[place] - 1e-9
                    if within is not None:
                        better &= found < within
                    np.minimum.at(best, place[better], found[better])
                    open_[place[better]] = True
                waiting = np.flatnonzero(open_)
            reached = np.minimum.reduceat(best.reshape(-1, wide), platforms, axis=0)
            station, origin = np.nonzero(np.isfinite(reached))
            out.append(pd.DataFrame({"origin_id": names[low + origin], "station_id": stations[platforms][station], "minutes": reached[station, origin]}))
        return pd.concat(out)

    dealt = boards.join(numbered, ["station_id", "line"]).select("origin_id", "state", "minutes", block.alias("block"))
    return dealt.repartition(tasks, "block").groupBy("block").applyInPandas(run, f"origin_id {kinds['origin_id']}, station_id {kinds['station_id']}, minutes double")


def _times_by_joins(best: DataFrame, moves: DataFrame, within: float | None, few: int = FEW_FRESH) -> DataFrame:
    """A round moves on what improved in the last one and keeps what beats the best so far; it ends when nothing does. Rounds cut their lineage.
    Up to `few` states that improved go to the tasks that read the moves, so a large network is not dealt anew in each round."""
    state = ["origin_id", "station_id", "line"]
    moves = moves.withColumnRenamed("minutes", "more")
    fresh, count = best, best.count()
    while count:
        moved = moves.join(F.broadcast(fresh) if count <= few else fresh.hint("merge"), ["station_id", "line"]).select("origin_id", F.col("to_station").alias("station_id"), F.col("to_line").alias("line"), (F.col("minutes") + F.col("more")).alias("minutes"))
        found = (moved if within is None else moved.filter(F.col("minutes") < within)).groupBy(*state).agg(F.min("minutes").alias("minutes"))
        known = best.groupBy(*state).agg(F.min("minutes").alias("known")).hint("merge")
        fresh = cut(found.join(known, state, "left").filter("known IS NULL OR minutes < known - 1e-9").drop("known"))
        count = fresh.count()
        best = cut(best.unionByName(fresh).groupBy(*state).agg(F.min("minutes").alias("minutes"))) if count else best
    return best.groupBy("origin_id", "station_id").agg(F.min("minutes").alias("minutes"))


#: Side of the cells by which stops_near goes, in degrees, and how many of them a walk to a station crosses at most.
CELLS_A_WALK = 4
STOP_CELL = C.ACCESS_WALK_M / (C.METERS_PER_DEGREE * math.cos(math.radians(C.CITY["max_lat"] + 1))) / CELLS_A_WALK
#: Slack of bounds, in minutes, beyond what rounding does.
_SLACK = 1e-6


def stops_near(arrivals: DataFrame, stations: DataFrame) -> DataFrame:
    """origin_id, cell_row, cell_col, stops (lat, lon, minutes): by cell, the stations that can be the best one to leave at for some
    point of it, of arrivals (origin_id, station_id, minutes). A station goes if another one, in reach of the whole cell, is better even
    from the cell's far end than this one from its near end; so it is a few a cell, however many stations are in reach."""
    step, size = F.sequence(F.lit(-CELLS_A_WALK), F.lit(CELLS_A_WALK)), F.lit(STOP_CELL)
    dealt = arrivals.filter("minutes IS NOT NULL").repartition(even_tasks(arrivals), "station_id")  # few bytes, but a row for each cell in reach
    rows = dealt.join(_dealt(stations.select("station_id", "lat", "lon"), stations), "station_id").withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step))
    rows = rows.withColumn("cell_row", cell(F.col("lat"), STOP_CELL) + F.col("dr")).withColumn("cell_col", cell(F.col("lon"), STOP_CELL) + F.col("dc"))

    def ends(x: str, at: str) -> tuple[Column, Column]:
        below, above = F.col(at) * size - F.col(x), (F.col(at) + 1) * size - F.col(x)
        return F.greatest(below, -above, F.lit(0.0)), F.greatest(F.abs(below), F.abs(above))

    (lat0, lat1), (lon0, lon1) = ends("lat", "cell_row"), ends("lon", "cell_col")
    shrink = lambda off: F.cos(F.radians(F.greatest(F.abs("lat") + off, F.lit(0.0))))  # noqa: E731  # between a point and a station
    least, most = (lat0 + lon0 * shrink(0.1)) * C.METERS_PER_DEGREE, (lat1 + lon1 * shrink(-0.1)) * C.METERS_PER_DEGREE
    rows = rows.withColumn("least", least).filter(F.col("least") <= C.ACCESS_WALK_M + 1).withColumn("most", most)
    sure = F.when(F.col("most") <= C.ACCESS_WALK_M - 1, F.col("most") / C.WALK_M_PER_MIN + F.col("minutes"))
    stop = F.struct("lat", "lon", "minutes", (F.col("least") / C.WALK_M_PER_MIN + F.col("minutes")).alias("early"))
    cells = rows.groupBy("origin_id", "cell_row", "cell_col").agg(F.collect_list(stop).alias("every"), F.min(sure).alias("best"))
    some = F.filter("every", lambda s: F.col("best").isNull() | (s.early <= F.col("best") + _SLACK))
    return cells.select("origin_id", "cell_row", "cell_col", F.transform(some, lambda s: F.struct(s.lat.alias("lat"), s.lon.alias("lon"), s.minutes.alias("minutes"))).alias("stops"))


def stops_far(arrivals: DataFrame, points: DataFrame) -> DataFrame:
    """origin_id, stop_id, far_minutes: arrivals at the stations that are the nearest one (stop_id, stop_meters) of some point that has none in reach."""
    far = points.filter(F.col("stop_meters") > C.ACCESS_WALK_M).select("stop_id").distinct()
    return arrivals.select("origin_id", F.col("station_id").alias("stop_id"), F.col("minutes").alias("far_minutes")).join(far, "stop_id", "left_semi").select("origin_id", "stop_id", "far_minutes")


def transit_minutes(trips: DataFrame, stations: DataFrame, arrivals: DataFrame) -> DataFrame:
    """trip_id, minutes of trips (trip_id, lat, lon, origin_id, to_lat, to_lon): the walk all the way, or by the best station near the trip's own end.

    Each trip meets the few stations of its cell that can be the best, as stops_near gives them, not all in reach; without any in reach its nearest one.
    """
    arrivals = cut(arrivals)
    placed = with_nearest(trips.select("trip_id", "lat", "lon", "origin_id", "to_lat", "to_lon"), stations, "stop_id", "stop_meters", "station_id")
    placed = placed.withColumn("cell_row", cell(F.col("lat"), STOP_CELL)).withColumn("cell_col", cell(F.col("lon"), STOP_CELL)).join(stops_near(arrivals, stations).hint("merge"), ["origin_id", "cell_row", "cell_col"], "left")
    placed = placed.join(arrivals.select("origin_id", F.col("station_id").alias("stop_id"), F.col("minutes").alias("far_minutes")).hint("merge"), ["origin_id", "stop_id"], "left")
    direct = manhattan_m(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")) / C.WALK_M_PER_MIN
    return placed.select("trip_id", F.least(direct, F.coalesce(net_minutes(F.col("lat"), F.col("lon")), direct)).alias("minutes"))


def net_minutes(lat: Column, lon: Column) -> Column:
    """By the best of `stops` within an access walk, else by the nearest station: stop_meters off and far_minutes from the origin."""
    meters = lambda s: manhattan_m(lat, lon, s.lat, s.lon)
    by_stop = F.array_min(F.transform("stops", lambda s: F.when(meters(s) <= C.ACCESS_WALK_M, meters(s) / C.WALK_M_PER_MIN + s.minutes)))
    return F.when(F.col("stop_meters") <= C.ACCESS_WALK_M, by_stop).otherwise(F.col("stop_meters") / C.WALK_M_PER_MIN + F.col("far_minutes"))


def commute_minutes(trips: DataFrame, stations: DataFrame, arrivals: DataFrame) -> DataFrame:
    """trip_id, mode, minutes; only transit trips meet the network. An unknown mode is an error."""
    ends = [F.col(c) for c in ("lat", "lon", "to_lat", "to_lon")]
    jam = in_box(ends[0], ends[1], C.ZONE) | in_box(ends[2], ends[3], C.ZONE)
    drive = haversine_km(*ends) / C.DRIVE_KMH * 60 * F.when(jam, C.CONGESTION).otherwise(1.0)
    other = F.raise_error(F.concat(F.lit("unknown commute mode: "), F.coalesce("mode", F.lit("null")))).cast("double")
    direct = trips.filter(F.coalesce("mode", F.lit("")) != "transit").select("trip_id", "mode", F.when(F.col("mode") == "walk", manhattan_m(*ends) / C.WALK_M_PER_MIN).when(F.col("mode") == "drive", drive).otherwise(other).alias("minutes"))
    routed = transit_minutes(trips.filter("mode = 'transit'"), stations, arrivals).select("trip_id", F.lit("transit").alias("mode"), "minutes")
    return direct.unionByName(routed)


#: Metres of the cells of the first level of circles; each level is twice as wide as the one before.
FIRST_LEVEL_M, LEVELS = 250.0, 10


def _by_level(circles: DataFrame) -> DataFrame:
    """circles (..., lat, lon, reach) filed in all cells that they touch, of cells about as wide as themselves: level, cr, cc."""
    level = F.least(F.greatest(F.ceil(F.log2(F.col("reach") / FIRST_LEVEL_M)), F.lit(0)), F.lit(LEVELS - 1)).cast("int")
    filed = circles.withColumn("level", level)
    wide = F.pow(F.lit(2.0), F.col("level")) * FIRST_LEVEL_M / C.METERS_PER_DEGREE
    lat_pad = F.col("reach") / C.METERS_PER_DEGREE
    lon_pad = F.col("reach") / (C.METERS_PER_DEGREE * F.cos(F.radians(F.least(F.abs("lat") + lat_pad, F.lit(89.0)))))
    span = lambda x, pad: F.sequence(F.floor((F.col(x) - pad) / wide), F.floor((F.col(x) + pad) / wide))
    return filed.withColumn("cr", F.explode(span("lat", lat_pad))).withColumn("cc", F.explode(span("lon", lon_pad)))


def without_contained(circles: DataFrame) -> DataFrame:
    """circles (origin_id, lat, lon, reach) without those that lie in a greater one of their origin: a circle that another contains adds
    nothing. A circle meets the others of its origin that are filed at its middle, level by level."""
    named = circles.withColumn("circle", F.xxhash64("origin_id", "lat", "lon", "reach")).dropDuplicates(["circle"])
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
    probes = named.withColumn("level", levels)
    wide = F.pow(F.lit(2.0), F.col("level")) * FIRST_LEVEL_M / C.METERS_PER_DEGREE
    probes = probes.withColumn("cr", F.floor(F.col("lat") / wide)).withColumn("cc", F.floor(F.col("lon") / wide))
    other = _by_level(named).select("origin_id", "level", "cr", "cc", *[F.col(c).alias(f"__{c}") for c in ("lat", "lon", "reach", "circle")])
    met = probes.join(other.hint("merge"), ["origin_id", "level", "cr", "cc"]).filter("circle <> __circle AND (__reach > reach OR (__reach = reach AND __circle < circle))")
    # Grid distances obey the triangle inequality but for the cosine of the latitude; a hundredth of the distance covers that.
    apart = manhattan_m(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon"))
    inside = met.filter(apart * 1.01 + F.col("reach") * 1.01 <= F.col("__reach")).select("circle").distinct()
    return named.join(inside.hint("merge"), "circle", "left_anti").drop("circle")


def _covered(circles: DataFrame, meters: float) -> DataFrame:
    """origin_id, cr, cc, whole, parts: a row for each origin and cell (so wide) that its circles touch: whether one has all of it, else those that have a part."""
    wide = meters / C.METERS_PER_DEGREE
    lat_pad = F.col("reach") / C.METERS_PER_DEGREE + 1e-9
    lon_pad = F.col("reach") / (C.METERS_PER_DEGREE * F.cos(F.radians(F.least(F.abs("lat") + lat_pad, F.lit(89.0))))) + 1e-9
    span = lambda x, pad: F.sequence(F.floor((F.col(x) - pad) / wide), F.floor((F.col(x) + pad) / wide))
    dealt = circles.withColumn("cr", F.explode(span("lat", lat_pad))).withColumn("cc", F.explode(span("lon", lon_pad)))
    south, north, west, east = F.col("cr") * wide, (F.col("cr") + 1) * wide, F.col("cc") * wide, (F.col("cc") + 1) * wide
    lats = [F.abs(south), F.abs(north), F.abs("lat")]
    across = lambda degrees, at: degrees * C.METERS_PER_DEGREE * F.cos(F.radians(at))
    near = F.greatest(F.lit(0.0), south - F.col("lat"), F.col("lat") - north) * C.METERS_PER_DEGREE + across(F.greatest(F.lit(0.0), west - F.col("lon"), F.col("lon") - east), F.greatest(*lats))
    far = F.greatest(F.abs(south - F.col("lat")), F.abs(north - F.col("lat"))) * C.METERS_PER_DEGREE + across(F.greatest(F.abs(west - F.col("lon")), F.abs(east - F.col("lon"))), F.least(*lats))
    # A thousandth covers the latitude at which widths are taken.
    dealt = dealt.withColumn("whole", far + 1e-3 <= F.col("reach") * 0.999).filter(near * 0.999 - 1e-3 <= F.col("reach"))
    each = dealt.groupBy("origin_id", "cr", "cc").agg(F.bool_or("whole").alias("whole"), F.collect_list(F.when(~F.col("whole"), F.struct("lat", "lon", "reach"))).alias("parts"))
    return each.withColumn("parts", F.when(~F.col("whole"), F.col("parts")))


def within_circles(points: DataFrame, circles: DataFrame, meters: float | None = None) -> DataFrame:
    """origin_id, id: the points (id, lat, lon) in a circle (origin_id, lat, lon, reach) of an origin, by distance along the grid.

    Points meet the origins by cells, each origin once, so the pairs are not gathered again; only ids that stand at several places are. Both sides are
    dealt by cell: cells of circles are many times more than the rows that Spark would broadcast them for. meters: the width of
    a cell, else an eighth of the widest circle."""
    if meters is None:
        meters = max((circles.agg(F.max("reach")).first()[0] or 0.0) / 8, FIRST_LEVEL_M)
    wide, tasks = meters / C.METERS_PER_DEGREE, even_tasks(points)
    filed = _covered(without_contained(circles), meters)
    single = filed.filter(F.col("whole") | (F.size("parts") == 1)).select("origin_id", "cr", "cc", F.inline(F.array(F.coalesce(F.when(~F.col("whole"), F.col("parts")[0]), F.struct(*[F.lit(None).cast("double").alias(c) for c in ("lat", "lon", "reach")])))).alias("__lat", "__lon", "__reach"))
    mixed = filed.filter(~F.col("whole") & (F.size("parts") > 1)).select("origin_id", "cr", "cc", "parts")
    known = points.filter("lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon")
    ids = known.groupBy("id").agg(F.min("lat").alias("lat"), F.max("lat").alias("__north"), F.min("lon").alias("lon"), F.max("lon").alias("__east"))
    one = (F.col("lat") == F.col("__north")) & (F.col("lon") == F.col("__east"))
    several = ids.filter(~one).select(F.col("id").alias("__id"))

    def met(rows: DataFrame) -> DataFrame:
        placed = rows.select("id", "lat", "lon", F.floor(F.col("lat") / wide).alias("cr"), F.floor(F.col("lon") / wide).alias("cc")).repartition(tasks, "cr", "cc")
        at = lambda cells: placed.join(cells.repartition(tasks, "cr", "cc").hint("merge"), ["cr", "cc"])
        # Nearly all cells have one circle or lie in one: pairs there are told by compiled code.
        inside = F.col("__reach").isNull() | (manhattan_m(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon")) <= F.col("__reach"))
        some = F.exists("parts", lambda c: manhattan_m(F.col("lat"), F.col("lon"), c.lat, c.lon) <= c.reach)
        return at(single).filter(inside).select("origin_id", "id").unionByName(at(mixed).filter(some).select("origin_id", "id"))

    return met(ids.filter(one)).unionByName(met(known.join(several, F.col("id").eqNullSafe(F.col("__id")), "left_semi")).distinct())


def reachable_set(points: DataFrame, stations: DataFrame, arrivals: DataFrame | None, origins: DataFrame, minutes: float, mode: str = "transit") -> DataFrame:
    """origin_id, id: the points within so many minutes of each origin. On foot and by car (mode walk, drive) that is one circle; with the
    network (transit) the circle on foot and one around each station that is reached with time left (only there arrivals are needed, and
    only those within the minutes). No time, no points; another mode is an error."""
    speed = {"walk": C.WALK_M_PER_MIN, "transit": C.WALK_M_PER_MIN, "drive": C.DRIVE_KMH * 1000 / 60}
    if mode not in speed:
        raise ValueError(f"unknown commute mode: {mode!r}")
    circles = origins.select("origin_id", "lat", "lon", F.lit(max(minutes, 0.0) * speed[mode]).alias("reach"))
    if mode == "transit":
        left = arrivals.filter(F.col("minutes") < minutes).join(stations.select("station_id", "lat", "lon"), "station_id")
        circles = circles.unionByName(left.select("origin_id", "lat", "lon", ((minutes - F.col("minutes")) * C.WALK_M_PER_MIN).alias("reach")))
    return within_circles(points, circles.filter("reach > 0"), max(max(minutes, 0.0) * speed[mode] / 8, FIRST_LEVEL_M))
