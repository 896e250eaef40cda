"""Queries over the transit network, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import transit
from ..sources import tables as T
from .catalog import MAN as _MAN
from .catalog import query

MAN = f"({_MAN})"

_LINES = "sl AS (SELECT DISTINCT station_id, unnest(list_filter([line, second_line], lambda x: x IS NOT NULL)) AS line FROM stations)"
_STEPS = "steps AS (SELECT * FROM (SELECT station_id AS a, lead(station_id) OVER (PARTITION BY line ORDER BY station_id) AS b FROM sl) WHERE b IS NOT NULL AND a <> b), adj AS (SELECT a, b FROM steps UNION SELECT b, a FROM steps)"
_WALKS = f"walks AS (SELECT x.station_id AS a, y.station_id AS b, {MAN.format(a='x', b='y')} / 80 AS minutes FROM stations x, stations y WHERE x.station_id <> y.station_id AND {MAN.format(a='x', b='y')} <= 700 AND NOT EXISTS (SELECT 1 FROM sl p JOIN sl q USING (line) WHERE p.station_id = x.station_id AND q.station_id = y.station_id))"
_WAIT = "CASE WHEN {t}.type = 'brt' THEN 5E0 WHEN {l} IN ('5', '7') THEN 6E0 WHEN {l} = '6' THEN 7.5E0 ELSE 4E0 END"
_EDGES = f"""lined AS (SELECT sl.*, type FROM sl JOIN stations USING (station_id)), raw AS (
SELECT p.station_id, p.line, q.station_id AS to_station, q.line AS to_line, CASE WHEN p.type = 'brt' THEN 2E0 ELSE 2.5E0 END AS minutes FROM lined p JOIN adj ON a = p.station_id JOIN lined q ON q.station_id = b AND q.line = p.line
UNION ALL SELECT p.station_id, p.line, q.station_id, q.line, CASE WHEN p.type = 'metro' THEN 1E0 ELSE 0E0 END + {_WAIT.format(t='q', l='q.line')} FROM lined p JOIN lined q ON p.station_id = q.station_id AND p.line <> q.line
UNION ALL SELECT p.station_id, p.line, q.station_id, q.line, minutes + {_WAIT.format(t='q', l='q.line')} FROM lined p JOIN walks ON a = p.station_id JOIN lined q ON q.station_id = b),
net_edges AS (SELECT station_id, line, to_station, to_line, min(minutes) AS minutes FROM raw GROUP BY ALL)"""
NETWORK = f"{_LINES}, {_STEPS}, {_WALKS}, {_EDGES}"
NET_CTE = T.with_tables("listings", "stations").replace("WITH ", "WITH RECURSIVE ", 1) + f", {NETWORK}"
#: A workplace for each supplier, beside its station.
WORKPLACE = "s_suppkey AS origin_id, (35550000 + s_suppkey * 5915587277 % 300000) / CAST(1000000 AS DOUBLE) AS lat, (51100000 + s_suppkey * 1500450271 % 500000) / CAST(1000000 AS DOUBLE) AS lon"
ACCESS = "{n} AS (SELECT p.{k}, s.station_id, {d} / 80 AS walk FROM {p} p, stations s WHERE {d} <= 1500 UNION ALL SELECT {k}, arg_min(station_id, d), min(d) / 80 FROM (SELECT p.{k}, s.station_id, {d} AS d FROM {p} p, stations s) GROUP BY {k} HAVING min(d) > 1500)"
DIST = MAN.format(a="p", b="s")
#: From a table `work` (origin_id, lat, lon).
ARRIVE = f"""origins AS (SELECT origin_id, round_even(lat * 10000, 0) / 10000 AS lat, round_even(lon * 10000, 0) / 10000 AS lon FROM work), {ACCESS.format(n='access', k='origin_id', p='origins', d=DIST)},
moves AS (SELECT * FROM net_edges UNION ALL SELECT station_id, line, station_id, line, 0E0 FROM sl),
hop AS (SELECT 0 AS n, origin_id, lined.station_id, lined.line, walk + {_WAIT.format(t='lined', l='lined.line')} AS minutes FROM access JOIN lined USING (station_id)
UNION ALL SELECT n + 1, origin_id, to_station, to_line, min(hop.minutes + moves.minutes) FROM hop JOIN moves USING (station_id, line) WHERE n < 60 GROUP BY n, origin_id, to_station, to_line),
arrivals AS (SELECT origin_id, station_id, min(minutes) AS minutes FROM hop WHERE n = 60 GROUP BY ALL)"""
ARRIVALS = f"work AS (SELECT {WORKPLACE} FROM supplier), {ARRIVE}"
#: Each home travels to one of the workplaces, in one of three ways.
TRIP = "l.id AS trip_id, l.lat, l.lon, w.origin_id, w.lat AS to_lat, w.lon AS to_lon, CASE l.ingest_seq % 3 WHEN 0 THEN 'walk' WHEN 1 THEN 'drive' ELSE 'transit' END AS mode"
_DIRECT = MAN.format(a="t", b="x").replace("x.lat", "t.to_lat").replace("x.lon", "t.to_lon") + " / 80"
_HAV = "pow(sin(radians(to_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(to_lat)) * pow(sin(radians(to_lon - lon) / 2), 2)"
TRIPS = f"trips AS (SELECT {TRIP} FROM listings l JOIN work w ON w.origin_id = l.ingest_seq % 10 + 1), {ACCESS.format(n='egress', k='trip_id', p='trips', d=DIST)}, net AS (SELECT trip_id, min(walk + minutes) AS net FROM egress JOIN trips USING (trip_id) JOIN arrivals USING (origin_id, station_id) GROUP BY 1), transit AS (SELECT t.trip_id, least({_DIRECT}, coalesce(net, {_DIRECT})) AS minutes FROM trips t LEFT JOIN net USING (trip_id))"


def stations_and_lines(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = T.stations(spark, d)
    return rows, transit.station_lines(rows)


def network(spark, d) -> DataFrame:
    rows, lines = stations_and_lines(spark, d)
    return transit.state_edges(rows, lines, transit.route_adjacency(lines), transit.walk_transfers(rows, lines))


def workplaces(spark, d) -> DataFrame:
    return T.table(spark, d, "supplier").selectExpr(*WORKPLACE.split(", "))


def arrivals(spark, d, asked: DataFrame | None = None, within: float | None = None) -> DataFrame:
    """From all workplaces, or those that rows asked (origin_id) name."""
    rows, lines = stations_and_lines(spark, d)
    work = workplaces(spark, d)
    work = work if asked is None else work.join(asked.select("origin_id").distinct(), "origin_id", "left_semi")
    return transit.arrival_times(work, rows, lines, network(spark, d), within)


def trips(spark, d) -> DataFrame:
    w = workplaces(spark, d).alias("w")
    return T.listings(spark, d).alias("l").join(w, F.expr("w.origin_id = l.ingest_seq % 10 + 1")).selectExpr("l.id AS trip_id", "l.lat", "l.lon", "w.origin_id", "w.lat AS to_lat", "w.lon AS to_lon", TRIP[TRIP.index("CASE"):])


def _minutes(df: DataFrame) -> DataFrame:
    return df.withColumn("minutes", F.round("minutes", 5))


@query("edges_symmetric", f"{T.with_tables('stations')}, raw AS (SELECT station_id AS a, station_id + s AS b FROM stations, (VALUES (1), (7)) t(s)), ok AS (SELECT a, b FROM raw WHERE b IN (SELECT station_id FROM stations)) SELECT a, b FROM ok UNION SELECT b, a FROM ok")
def _(spark, d):
    rows = T.stations(spark, d)
    return transit.symmetric(rows.select(F.col("station_id").alias("a"), F.explode(F.array(F.col("station_id") + 1, F.col("station_id") + 7)).alias("b")), rows)


@query("route_adjacency", f"{T.with_tables('stations')}, {_LINES}, {_STEPS} SELECT a, b FROM adj")
def _(spark, d):
    return transit.route_adjacency(stations_and_lines(spark, d)[1])


@query("walk_transfers", f"{T.with_tables('stations')}, {_LINES}, {_WALKS} SELECT a, b, round(minutes, 5) AS minutes FROM walks")
def _(spark, d):
    return _minutes(transit.walk_transfers(*stations_and_lines(spark, d)))


@query("stop_merge", f"{T.with_tables('stations').replace('WITH ', 'WITH RECURSIVE ', 1)}, near AS (SELECT x.station_id AS a, y.station_id AS b FROM stations x, stations y WHERE {MAN.format(a='x', b='y')} <= 150), r AS (SELECT station_id, station_id AS stop FROM stations UNION SELECT b, stop FROM r JOIN near ON a = r.station_id) SELECT station_id, min(stop) AS stop FROM r GROUP BY 1")
def _(spark, d):
    return transit.stop_merge(T.stations(spark, d))


@query("state_edges", f"{NET_CTE} SELECT station_id, line, to_station, to_line, round(minutes, 5) AS minutes FROM net_edges")
def _(spark, d):
    return _minutes(network(spark, d))


@query("arrival_times", f"{NET_CTE}, {ARRIVALS} SELECT origin_id, station_id, round(minutes, 5) AS minutes FROM arrivals")
def _(spark, d):
    return _minutes(arrivals(spark, d))


@query("transit_minutes", f"{NET_CTE}, {ARRIVALS}, {TRIPS} SELECT trip_id, round(minutes, 5) AS minutes FROM transit")
def _(spark, d):
    asked = trips(spark, d)
    return _minutes(transit.transit_minutes(asked, T.stations(spark, d), arrivals(spark, d, asked)))


@query("commute_minutes", f"{NET_CTE}, {ARRIVALS}, {TRIPS}, h AS (SELECT *, {_HAV} AS h FROM trips) SELECT trip_id, mode, round(CASE mode WHEN 'walk' THEN {_DIRECT} WHEN 'drive' THEN 6371 * 2 * atan2(sqrt(h), sqrt(1 - h)) / 22 * 60 * CASE WHEN (lat BETWEEN 35.7E0 AND 35.735E0 AND lon BETWEEN 51.39E0 AND 51.435E0) OR (to_lat BETWEEN 35.7E0 AND 35.735E0 AND to_lon BETWEEN 51.39E0 AND 51.435E0) THEN 1.4E0 ELSE 1E0 END ELSE transit.minutes END, 5) AS minutes FROM h t JOIN transit USING (trip_id)")
def _(spark, d):
    asked = trips(spark, d)
    return _minutes(transit.commute_minutes(asked, T.stations(spark, d), arrivals(spark, d, asked.filter("mode = 'transit'"))))


@query("reachable_set", f"{NET_CTE}, {ARRIVALS}, circles AS (SELECT origin_id, lat, lon, 30 * 80E0 AS reach FROM work UNION ALL SELECT origin_id, lat, lon, (30 - minutes) * 80 FROM arrivals JOIN stations USING (station_id) WHERE minutes < 30) SELECT DISTINCT s.origin_id, p.id FROM listings p JOIN circles s ON {DIST} <= s.reach")
def _(spark, d):
    return transit.reachable_set(T.listings(spark, d), T.stations(spark, d), arrivals(spark, d, within=30.0), workplaces(spark, d), 30.0)


@query("reachable_walk_drive", f"""{T.with_tables("listings")}, work AS (SELECT {WORKPLACE} FROM supplier) SELECT DISTINCT s.origin_id, p.id, 'walk' AS mode FROM listings p JOIN work s ON {DIST} <= 12 * 80E0 UNION ALL SELECT DISTINCT s.origin_id, p.id, 'drive' FROM listings p JOIN work s ON {DIST} <= 9 * 22E0 * 1000 / 60""")
def _(spark, d):
    """Twelve minutes on foot, nine by car."""
    points = T.listings(spark, d)
    rows = [transit.reachable_set(points, T.stations(spark, d), None, workplaces(spark, d), m, mode).withColumn("mode", F.lit(mode)) for m, mode in ((12.0, "walk"), (9.0, "drive"))]
    return rows[0].unionByName(rows[1])
