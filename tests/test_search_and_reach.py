"""Text search and reach against brute force, and what their plans multiply."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from homerank import constants as C
from homerank import registry
from homerank.functions.geo import manhattan_m, to_millimeters
from homerank.operators import search, spatial, textsearch, transit
from homerank.plans import searches


def brute_search(texts, queries, most):
    words = {i: [w for w in (t or "").lower().split() if w] for i, t in texts}
    docs, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = set()
    for q, text in queries:
        asked = set((text or "").lower().split())
        hits = []
        for i, ws in words.items():
            if asked and asked <= set(ws):
                tf = Counter(ws)
                score = sum(math.log(1 + (docs - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (C.BM25_K1 + 1) / (tf[w] + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * len(ws) / mean)) for w in asked)
                hits.append((-round(score, 9), i, round(score, 6)))
        out |= {(q, i, s) for _, i, s in sorted(hits)[:most]}
    return out


@pytest.mark.parametrize("most, block", [(500, 1_000_000), (3, 4)])
def test_search_equals_brute_force(spark, most, block):
    rnd = random.Random(6)
    word = lambda: f"w{min(int(rnd.expovariate(0.3)), 12)}"
    texts = [(i, "all " + " ".join(word() for _ in range(rnd.randint(0, 15)))) for i in range(120)] + [(500, None), (501, "")]
    queries = [(q, " ".join(["all"] * rnd.randint(0, 1) + [word() for _ in range(rnd.randint(0, 4))])) for q in range(40)] + [(100, "missing all"), (101, None), (102, "w1 w2 w3 w4 w5 w6 all"), (103, "ALL"), (104, "all")]
    got = textsearch.search(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(queries, "query_id int, text string"), most, block)
    assert {(r["query_id"], r["id"], round(r["score"], 6)) for r in got.collect()} == brute_search(texts, queries, most)


@pytest.mark.parametrize("few_terms, few_texts", [(0, 0), (0, 1000), (1000, 0), (1000, 1000)])
def test_search_is_the_same_however_its_tables_are_dealt(spark, few_terms, few_texts):
    rnd = random.Random(12)
    words = lambda most: " ".join(f"w{min(int(rnd.expovariate(0.3)), 9)}" for _ in range(rnd.randint(0, most)))
    texts = [(i, f"\t All {words(12)}\r\n") for i in range(90)] + [(500, None), (501, " \n")]
    queries = [(q, words(5)) for q in range(25)] + [(100, "missing all"), (101, None), (102, " "), (103, "ALL all")]
    got = textsearch.search(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(queries, "query_id int, text string"), 20, 40, few_terms, few_texts)
    assert {(r["query_id"], r["id"], round(r["score"], 6)) for r in got.collect()} == brute_search(texts, queries, 20)


def test_search_keeps_postings_of_found_texts_alone(spark, monkeypatch):
    """Texts that no query finds by its rarest term give no postings, however many of the asked terms they have."""
    kept, cut = [], textsearch.cut
    monkeypatch.setattr(textsearch, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    texts = spark.range(400).selectExpr("id", "'all of the common words' || if(id = 7, ' rare', '') AS text")
    queries = spark.createDataFrame([(1, "all of the rare words"), (2, "common rare")], "query_id int, text string")
    assert {(r["query_id"], r["id"]) for r in textsearch.search(texts, queries).collect()} == {(1, 7), (2, 7)}
    assert max(df.count() for df in kept) <= 10


def grid(a, b, c, d):
    return abs(a - c) * C.METERS_PER_DEGREE + abs(b - d) * C.METERS_PER_DEGREE * math.cos(math.radians((a + c) / 2))


def test_reach_equals_brute_force(spark):
    rnd = random.Random(9)
    points = [(f"p{i}", rnd.uniform(35.6, 35.8), rnd.uniform(51.2, 51.5)) for i in range(600)]
    circles = [(rnd.randint(0, 3), rnd.uniform(35.6, 35.8), rnd.uniform(51.2, 51.5), rnd.choice([40.0, 300.0, 900.0, 2500.0, 20_000.0 if rnd.random() < 0.1 else 1200.0])) for _ in range(150)]
    circles += [circles[0], (9, 35.7, 51.3, 60_000.0), (9, 35.71, 51.31, 100.0)]
    frame = spark.createDataFrame(circles, "origin_id int, lat double, lon double, reach double")
    places = spark.createDataFrame(points, "id string, lat double, lon double")
    want = {(o, i) for o, a, b, r in circles for i, c, d in points if grid(c, d, a, b) <= r}
    assert {tuple(r) for r in transit.within_circles(places, frame).collect()} == want
    # Contained circles are gone before points meet any: the small one in the widest, and the repeated one.
    left = transit.without_contained(frame)
    assert left.filter("origin_id = 9").count() == 1 and left.count() < len(set(circles))


def test_modes_of_reach(spark):
    points = spark.createDataFrame([("near", 35.7, 51.405), ("far", 35.7, 51.43)], "id string, lat double, lon double")
    origins = spark.createDataFrame([(1, 35.7, 51.4)], "origin_id int, lat double, lon double")
    stations = spark.createDataFrame([(5, 35.7, 51.428)], "station_id int, lat double, lon double")
    arrivals = spark.createDataFrame([(1, 5, 6.0)], "origin_id int, station_id int, minutes double")
    reach = lambda minutes, mode: {r["id"] for r in transit.reachable_set(points, stations, arrivals, origins, minutes, mode).collect()}
    assert reach(10.0, "walk") == {"near"} and reach(10.0, "drive") == {"near", "far"} == reach(10.0, "transit") and reach(0.0, "walk") == reach(-5.0, "transit") == set()
    with pytest.raises(ValueError):
        reach(10.0, "teleport")


def test_walks_to_the_metro_need_no_other_column_of_homes(spark, sf, monkeypatch):
    """Stations in reach and vectors, which make homes large, are not made for them."""
    monkeypatch.setattr(searches, "homes", lambda *a: pytest.fail("homes are made"))
    assert registry.queries()["refresh_metro_walk"](spark, sf).count() > 0


def test_commute_takes_the_best_of_all_stations_in_reach(spark):
    stations = spark.createDataFrame([(i, 35.60 + i * 7919 % 1009 / 10090, 51.20 + i * 104729 % 997 / 9970) for i in range(3000)] + [(9999, 35.80, 51.55)], "station_id bigint, lat double, lon double")
    arrivals = stations.select(F.lit(1).alias("origin_id"), "station_id", F.when(F.col("station_id") % 11 > 0, F.pmod(F.xxhash64("station_id"), F.lit(400)) / 10.0 + 1).alias("minutes")).cache()
    points = spark.createDataFrame([(i, 35.59 + i * 31 % 101 / 880, 51.19 + i * 57 % 103 / 880) for i in range(120)] + [(500, 35.82, 51.58)], "id bigint, lat double, lon double")
    homes = spatial.with_nearest(points, stations, "stop_id", "stop_meters", "station_id").cache()
    near, far = transit.stops_near(arrivals, stations).withColumnRenamed("origin_id", "search_id").cache(), transit.stops_far(arrivals, homes).withColumnRenamed("origin_id", "search_id")
    asked = spark.createDataFrame([(1, 35.65, 51.25, "transit")], "search_id int, workplace_lat double, workplace_lon double, commute_mode string")
    got = {r["id"]: r["m"] for r in search.with_stops(homes.crossJoin(asked), near, far).select("id", search.commute_minutes().alias("m")).collect()}
    every = points.crossJoin(arrivals.join(stations, "station_id").select(F.col("lat").alias("y"), F.col("lon").alias("x"), "minutes")).withColumn("meters", manhattan_m(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")))
    least = every.groupBy("id").agg(F.min("meters").alias("nearest")).join(every, "id").filter((F.col("meters") <= 1500) | ((F.col("nearest") > 1500) & (F.col("meters") == F.col("nearest"))))
    brute = least.groupBy("id", "lat", "lon").agg(F.min(F.col("meters") / 80 + F.col("minutes")).alias("net"))
    walk = manhattan_m(F.col("lat"), F.col("lon"), F.lit(35.65), F.lit(51.25)) / 80
    want = {r["id"]: r["m"] for r in brute.select("id", F.least(walk, "net").alias("m")).collect()}
    assert got == want and len(got) == 121
    assert near.agg(F.avg(F.size("stops"))).first()[0] < 40  # of some 90 that are in reach


def test_points_of_few_views_are_not_shuffled(spark):
    """Three views are three keys: points that met them by a shuffle would stand in three tasks."""
    points = spark.range(100).selectExpr("id % 3 AS search_id", "id", "35.6 + id / 1000 AS lat", "51.3 + id / 1000 AS lon")
    views = spark.createDataFrame([(0, 35.6, 35.7, 51.3, 51.4, 12.0), (1, 35.6, 35.7, 51.3, 51.4, 17.0)], "search_id bigint, min_lat double, max_lat double, min_lon double, max_lon double, zoom double")
    from homerank.operators import spatial

    made = spatial.clusters_and_pins(points, views.drop("zoom"), views)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") <= 2  # cells with their zooms, in badges and in pins: twelve rows a view
    assert made.filter("search_id = 2").count() == 33


def test_cosines_take_a_norm_once_and_use_all_tasks(spark):
    from homerank.operators import search

    rows = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 0.0], [1.0, 1.0], None, [2.0], []])], "vec_id bigint, embedding array<float>").coalesce(1)
    asked = rows.filter("vec_id <> 3").selectExpr("vec_id AS query_id", "embedding AS e")
    made = search.cosines(rows, asked)
    want = search.against_all(rows, asked).select("query_id", "vec_id", search.cosine("embedding", "e").alias("similarity"))
    assert made.exceptAll(want).isEmpty() and want.exceptAll(made).isEmpty() and made.count() == 30
    assert "RoundRobin" in (p := made._jdf.queryExecution().executedPlan().toString()) or "hashpartitioning(vec_id" in p


@pytest.mark.parametrize("lat", [35.7, 0.0, -35.7, 61.0])
def test_places_in_reach_are_those_of_all_pairs_and_cells_bring_few_others(spark, lat):
    """Also far from the city, where a degree of longitude is narrower; of the pairs that meet in a cell most are results."""
    rng = np.random.default_rng(11)
    spots = lambda n: [(lat + float(x), 51.3 + float(y)) for x, y in rng.uniform(-0.05, 0.05, (n, 2))]
    homes, places = spots(400), spots(300)
    left, right = spark.createDataFrame([(i, *p) for i, p in enumerate(homes)] + [(-1, None, 51.3)], "id int, lat double, lon double"), spark.createDataFrame([(i, *p) for i, p in enumerate(places)] + [(-1, lat, None)], "station_id int, lat double, lon double")
    got = {(r["id"], r["station_id"]): r["meters"] for r in spatial.within_radius(left, right, 1500.0).collect()}
    want = {(i, j): grid(*a, *b) for i, a in enumerate(homes) for j, b in enumerate(places) if grid(*a, *b) <= 1500}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    rows, columns = 1500 / 111320 / spatial.RADIUS_CELLS, 1500 / spatial._least_meters(35.85) / spatial.RADIUS_CELLS
    share = spatial._reached(right.selectExpr("station_id", "lat AS __lat", "lon AS __lon"), 1500.0, rows, columns).count() * rows * columns / len(places)
    diamond = 2 * (1500 / 111320) ** 2 / math.cos(math.radians(lat))
    assert diamond < share < 1.8 * diamond


def test_millimeters_are_rounded_as_in_sql(spark):
    """By the thousandfold, not by the digits that a double is written with."""
    import duckdb

    values = [0.0, 0.0005, 0.0004999999999999999, 2.0005, 1.0005, 1.0015, 8.3455, 1499.9995, 1234.5675, 0.49999999999999994e-3, *(i / 2000 for i in range(1, 4000, 37))]
    got = [r["m"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(to_millimeters(F.col("v")).alias("m")).collect()]
    assert got == [x for (x,) in duckdb.sql("SELECT round(v, 3) FROM (SELECT unnest($1) AS v)", params=[values]).fetchall()]


def test_many_places_are_not_broadcast_by_cell(spark):
    """Nearest places by joins on cells, by arrays, and by joins of dealt points are the same; only few places wait in broadcast cells."""
    rnd = random.Random(4)
    points = [(i, rnd.uniform(35.5, 35.9), rnd.uniform(51.0, 51.7)) for i in range(300)] + [(900, None, 51.2), (901, 80.0, 51.2), (902, 35.6, 51.3)]
    places = [(i, rnd.uniform(35.6, 35.62), rnd.uniform(51.2, 51.22)) for i in range(200)] + [(951, 35.6, 51.3), (950, 35.6, 51.3)]
    points, places = spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(places, "station_id int, lat double, lon double")
    found = [spatial.with_nearest(points, places, few=few, most=most) for few, most in ((10_000, 10_000), (10, 10_000), (10, 10))]
    rows = [sorted(map(tuple, df.select("id", "station_id", F.round("meters", 6)).collect())) for df in found]
    assert rows[0] == rows[1] == rows[2] and rows[0][-1] == (902, 950, 0.0) and [r[1] for r in rows[0][-3:-1]] == [None, None]
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in found]
    assert "BroadcastExchange" not in plans[1] + plans[2] and "Exchange" not in plans[1]
