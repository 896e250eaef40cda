"""Travel times over the network: by blocks and by joins, and from the workplaces that are asked for alone."""

from pyspark.sql import functions as F

from homerank import registry
from homerank.operators import transit
from homerank.plans import network
from homerank.sources import tables as T


def times(df):
    return sorted((r["origin_id"], r["station_id"], round(r["minutes"], 5)) for r in df.collect())


def test_blocks_equal_joins(spark, sf):
    rows, lines = network.stations_and_lines(spark, sf)
    work, edges = network.workplaces(spark, sf), network.network(spark, sf)
    joined = times(transit.arrival_times(work, rows, lines, edges, most_moves=0))
    assert joined == times(transit.arrival_times(work, rows, lines, edges))
    near = [t for t in joined if t[2] < 30]
    assert near == times(transit.arrival_times(work, rows, lines, edges, 30.0)) == times(transit.arrival_times(work, rows, lines, edges, 30.0, 0)) and len(near) < len(joined)


def test_only_workplaces_that_are_asked_for(spark, sf, monkeypatch):
    """Ten workplaces have trips, however many there are; circles on foot and by car take no travel times."""
    real, seen = transit.arrival_times, []
    work = T.table(spark, sf, "supplier").select(F.explode(F.sequence(F.lit(1), F.lit(40))).alias("origin_id"), F.lit(35.7).alias("lat"), F.lit(51.4).alias("lon")).dropDuplicates(["origin_id"])
    monkeypatch.setattr(network, "workplaces", lambda s, d: work)
    monkeypatch.setattr(transit, "arrival_times", lambda origins, *a: seen.append(origins.count()) or real(origins, *a))
    for name in ("commute_minutes", "transit_minutes"):
        registry.queries()[name](spark, sf)
    assert seen and max(seen) <= 10
    seen.clear()
    registry.queries()["reachable_walk_drive"](spark, sf)
    assert not seen


def test_ids_at_several_places_are_met_once(spark):
    points = spark.createDataFrame([("a", 35.7, 51.4), ("a", 35.7, 51.4), ("a", 35.701, 51.401), ("b", 35.9, 51.4), (None, 35.7, 51.4), ("c", None, 51.4)], "id string, lat double, lon double")
    circles = spark.createDataFrame([(1, 35.7, 51.4, 900.0), (1, 35.702, 51.4, 900.0), (2, 35.7, 51.4, 1.0)], "origin_id int, lat double, lon double, reach double")
    assert sorted(map(tuple, transit.within_circles(points, circles).collect()), key=repr) == sorted([(1, "a"), (2, "a"), (1, None), (2, None)], key=repr)


def test_trips_meet_a_few_stations_of_their_cell(spark, monkeypatch):
    """Not all that are within an access walk: pairs of trips and stations are never made."""
    stations = spark.createDataFrame([(i, 35.70 + i % 20 / 3000, 51.40 + i // 20 / 3000) for i in range(300)] + [(999, 35.85, 51.6)], "station_id bigint, lat double, lon double")
    arrivals = stations.select(F.lit(1).alias("origin_id"), "station_id", (F.col("station_id") * 7 % 90 / 10.0 + 1).alias("minutes"))
    trips = spark.createDataFrame([(i, 35.695 + i / 2500, 51.40 + i / 4000, 1, 35.60, 51.20) for i in range(40)] + [(40, 35.84, 51.57, 1, 35.84, 51.58), (41, None, 51.4, 1, 35.6, 51.2)], "trip_id int, lat double, lon double, origin_id int, to_lat double, to_lon double")
    every = trips.join(arrivals.join(stations.select("station_id", F.col("lat").alias("y"), F.col("lon").alias("x")), "station_id"), "origin_id").withColumn("m", transit.manhattan_m(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")))
    near = every.groupBy("trip_id").agg(F.min("m").alias("least")).join(every, "trip_id").filter("m <= 1500 OR (least > 1500 AND m = least)")
    direct = transit.manhattan_m(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")) / 80
    want = {r["trip_id"]: round(r["t"], 5) for r in near.groupBy("trip_id").agg(F.min(F.least(direct, F.col("minutes") + F.col("m") / 80)).alias("t")).collect() if r["t"] is not None} | {41: None}
    monkeypatch.setattr(transit, "reachable_stations", lambda *a: (_ for _ in ()).throw(AssertionError("all stations in reach")))
    got = {r["trip_id"]: r["minutes"] and round(r["minutes"], 5) for r in transit.transit_minutes(trips, stations, arrivals).collect()}
    assert got == want


def test_moves_that_take_no_time(spark):
    """Blocks take states in the order of their minutes; a move of no time opens a state again."""
    stations = spark.createDataFrame([(i, 35.7, 51.4 + i / 10, "metro", "1", None) for i in range(4)], "station_id bigint, lat double, lon double, type string, line string, second_line string")
    lines = transit.station_lines(stations)
    edges = spark.createDataFrame([(0, "1", 1, "1", 3.0), (0, "1", 2, "1", 1.0), (2, "1", 1, "1", 0.0), (1, "1", 3, "1", 0.25)], "station_id bigint, line string, to_station bigint, to_line string, minutes double")
    origins = spark.createDataFrame([("a", 35.7, 51.4)], "origin_id string, lat double, lon double")
    assert times(transit.arrival_times(origins, stations, lines, edges)) == [("a", 0, 4.0), ("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 5.25)]


def test_cells_of_circles_are_dealt(spark):
    """They are hundreds of a circle: sent to every task for the few bytes of their circles, they filled the driver."""
    points = spark.createDataFrame([("a", 35.7, 51.4), ("b", 35.72, 51.4)], "id string, lat double, lon double")
    circles = spark.createDataFrame([(1, 35.7, 51.4, 900.0), (2, 35.71, 51.4, 1500.0)], "origin_id int, lat double, lon double, reach double")
    met = transit.within_circles(points, circles, 250.0)
    assert sorted(map(tuple, met.collect())) == [(1, "a"), (2, "a"), (2, "b")]
    # Only the ids that stand at several places, of which there are none here, may be sent.
    assert "BroadcastHashJoin [cr" not in met._jdf.queryExecution().executedPlan().toString()


def test_origins_are_dealt_to_many_tasks(spark, sf):
    rows = network.arrivals(spark, sf).select(F.spark_partition_id().alias("task")).distinct().collect()
    assert len(rows) > 1
