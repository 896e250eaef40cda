"""Queries of searches against homes, with their SQL. They read one prepared table of homes, which stands for the stored corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import money
from ..functions.geo import manhattan_m
from ..operators import market, pareto, quality, search, spatial, transit
from ..operators.iterate import cut
from ..sources import tables as T
from ..sources.prepared import kept
from .catalog import BAND, FDE, MARKET_CTE, NEAREST, SHOWN, SHOWN_COLUMNS, TMC, _placed, query, show
from .network import ACCESS, ARRIVE, DIST, MAN, NETWORK, network, stations_and_lines
from .studies import INDEX, areas_in_districts


def homes(spark: SparkSession, d: str) -> DataFrame:
    """The listings with area, nearest metro, nearest station and vector."""

    def make() -> DataFrame:
        stations, vectors = T.stations(spark, d), T.table(spark, d, "embeddings").select("vec_id", "embedding")
        placed = _placed(spark, d).repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), "id")  # even tasks and files, however the adverts came; narrow rows as yet
        rows = spatial.with_nearest(placed, stations.filter("type = 'metro'"), "metro_id", "metro_meters", "station_id").withColumn("metro_walk_mins", F.col("metro_meters") / C.WALK_M_PER_MIN)
        rows = spatial.with_nearest(rows, stations, "stop_id", "stop_meters", "station_id")
        return rows.withColumn("vec_id", F.col("ingest_seq") % vectors.count()).join(vectors.withColumn("embedding_norm", search.norm("embedding")), "vec_id", "left")

    return kept(spark, d, "homes", make)


def market_of(spark: SparkSession, d: str, stream: DataFrame | None = None) -> DataFrame:
    """homes, or a stream of them, with baseline, city_tmc and quality, as their areas have them."""
    rows = homes(spark, d)
    areas = kept(spark, d, "area-baselines", lambda: market.area_baselines(rows))
    city = kept(spark, d, "city-baseline", lambda: market.city_baseline(rows))
    index = kept(spark, d, "quality-index", lambda: quality.quality_index(rows, areas_in_districts(spark, d)))
    rows = (rows if stream is None else stream).join(areas.select("area_key", "baseline"), "area_key", "left").join(index.select("area_key", F.col("score").alias("quality")), "area_key", "left")
    return rows.crossJoin(F.broadcast(city)).withColumn("baseline", F.coalesce("baseline", "city_per_sqm")).drop("city_per_sqm")  # one row


def saved_searches(spark: SparkSession, d: str) -> DataFrame:
    """The searches with the vector that they wish for."""

    def make() -> DataFrame:
        wishes = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("soft_vec"), F.col("embedding").alias("wish"))
        return T.intents(spark).join(wishes, "soft_vec", "left").repartition("search_id")  # few searches make one file, many make many

    return kept(spark, d, "searches", make)


def stops(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """By search with a workplace that is reached by the network: minutes at the stations near each cell, and at those far from homes."""
    stations, lines = stations_and_lines(spark, d)

    def reached() -> DataFrame:
        work = T.intents(spark).filter("commute_mode = 'transit' AND workplace_lat IS NOT NULL AND workplace_lon IS NOT NULL").select(F.col("search_id").alias("origin_id"), F.col("workplace_lat").alias("lat"), F.col("workplace_lon").alias("lon"))
        return transit.arrival_times(work, stations, lines, network(spark, d))

    arrivals = kept(spark, d, "search-arrivals", reached)
    near = kept(spark, d, "stops-near", lambda: transit.stops_near(arrivals, T.stations(spark, d)).withColumnRenamed("origin_id", "search_id"))
    return near, kept(spark, d, "stops-far", lambda: transit.stops_far(arrivals, homes(spark, d)).withColumnRenamed("origin_id", "search_id"))


def _tuned(spark: SparkSession) -> None:
    """HotSpot never compiles methods beyond 8000 bytes; plans whose one method would be longer run operator by operator instead."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def scored(spark: SparkSession, d: str) -> DataFrame:
    _tuned(spark)
    return search.scored(market_of(spark, d), saved_searches(spark, d), *stops(spark, d))


def ranked(spark: SparkSession, d: str, most: int = C.STORED_ROWS) -> DataFrame:
    _tuned(spark)
    return search.ranked(market_of(spark, d), saved_searches(spark, d), *stops(spark, d), most)


def passing(spark: SparkSession, d: str) -> DataFrame:
    _tuned(spark)
    return search.passing(market_of(spark, d), saved_searches(spark, d), *stops(spark, d))


def _weight_sql(k: str, i: int) -> str:
    own = f"CASE WHEN given THEN user_weights[{i + 1}] ELSE {C.WEIGHTS[k]}E0 END"
    when = {"commute": ("workplace_lat IS NOT NULL AND workplace_lon IS NOT NULL", f"({own}) * (commute_importance / 0.5E0)"), "area": ("min_area IS NOT NULL OR max_area IS NOT NULL", own), "soft": ("soft_vec IS NOT NULL", own)}
    return f"CASE WHEN {when[k][0]} THEN {when[k][1]} ELSE 0E0 END AS v_{k}" if k in when else f"{own} AS v_{k}"


_SUM = " + ".join(f"v_{k}" for k in search.UTILITIES)
WEIGHTS_CTE = f"""iw AS (SELECT *, coalesce(list_sum(user_weights), 0) > 0 AS given FROM intents),
wi AS (SELECT *, {", ".join(_weight_sql(k, i) for i, k in enumerate(search.UTILITIES))} FROM iw),
wn AS (SELECT *, {", ".join(f"CASE WHEN {_SUM} > 0 THEN v_{k} / ({_SUM}) ELSE {C.WEIGHTS[k]}E0 END AS w_{k}" for k in search.UTILITIES)} FROM wi)"""
_HAV = "pow(sin(radians(workplace_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(workplace_lat)) * pow(sin(radians(workplace_lon - lon) / 2), 2)"
_WALK = MAN.format(a="t", b="x").replace("x.lat", "t.workplace_lat").replace("x.lon", "t.workplace_lon") + " / 80"
_JAM = "CASE WHEN (lat BETWEEN 35.7E0 AND 35.735E0 AND lon BETWEEN 51.39E0 AND 51.435E0) OR (workplace_lat BETWEEN 35.7E0 AND 35.735E0 AND workplace_lon BETWEEN 51.39E0 AND 51.435E0) THEN 1.4E0 ELSE 1E0 END"
_HAS = {"has_parking": "has_parking", "has_elevator": "(has_elevator OR floor <= 1)", "has_storage": "has_storage", "has_balcony": "has_balcony"}
_ASKED = {k: k.replace("has_", "wants_") for k in C.AMENITIES}
_SOME = "(" + " OR ".join(_ASKED.values()) + ")"
_TOTAL = " + ".join(f"CASE WHEN NOT {_SOME} OR {_ASKED[k]} THEN {w}E0 ELSE 0E0 END" for k, w in C.AMENITIES.items())
_GOT = " + ".join(f"CASE WHEN (NOT {_SOME} OR {_ASKED[k]}) AND {_HAS[k]} THEN {w}E0 ELSE 0E0 END" for k, w in C.AMENITIES.items())
_BASE_CTES = ("listings", "area_base", "areas", "edges")
SEARCH_CTE = T.with_tables(*_BASE_CTES, "stations", "intents").replace("WITH ", "WITH RECURSIVE ", 1) + MARKET_CTE[len(T.with_tables(*_BASE_CTES)):] + f""", {INDEX}, {NEAREST}, {NETWORK},
work AS (SELECT search_id AS origin_id, workplace_lat AS lat, workplace_lon AS lon FROM intents WHERE commute_mode = 'transit' AND workplace_lat IS NOT NULL AND workplace_lon IS NOT NULL), {ARRIVE},
{ACCESS.format(n='egress', k='id', p='listings', d=DIST)}, net AS (SELECT origin_id AS search_id, id, min(walk + minutes) AS net FROM egress JOIN arrivals USING (station_id) GROUP BY ALL),
{WEIGHTS_CTE}, nv AS (SELECT count(*) AS nv FROM embeddings),
p0 AS (SELECT l.*, i.*, coalesce(b.baseline, c.city_per_sqm) AS baseline, c.city_tmc, n.meters / 80 AS metro_walk_mins, coalesce(q.score, 0.5E0) AS u_quality, {FDE} AS fde, nullif(max_deposit, 0) AS md, nullif(max_rent, 0) AS mr, {BAND}
  FROM placed l JOIN wn i ON l.is_shared = (i.living_kind = 'shared') LEFT JOIN base b ON b.area_key = l.area_key LEFT JOIN qi q ON q.area_key = l.area_key JOIN nearest n ON n.id = l.id CROSS JOIN city c
  WHERE (NOT wants_parking OR has_parking) AND (NOT wants_storage OR has_storage) AND (NOT wants_balcony OR has_balcony) AND (NOT wants_images OR image_count > 0) AND (NOT full_deposit_only OR is_full_deposit) AND (NOT convertible_only OR can_convert)
  AND (min_rooms IS NULL OR rooms >= min_rooms) AND (min_floor IS NULL OR floor >= min_floor) AND (max_floor IS NULL OR floor <= max_floor) AND (min_build_year IS NULL OR coalesce(build_year >= min_build_year, false))
  AND (min_deposit IS NULL OR deposit >= min_deposit) AND (min_rent IS NULL OR rent >= min_rent) AND (len(area_keys) = 0 OR l.area_key IS NULL OR list_contains(area_keys, l.area_key))),
p1 AS (SELECT *, CASE WHEN lower_deposit = upper_deposit THEN NULL WHEN md IS NOT NULL AND deposit > md THEN greatest(lower_deposit, least(upper_deposit, md)) WHEN persona = 'prefer_higher_deposit' THEN upper_deposit WHEN persona = 'prefer_higher_rent' THEN lower_deposit END AS target FROM p0),
p2 AS (SELECT *, coalesce(target, deposit) AS split_deposit, CASE WHEN target IS NULL THEN rent ELSE greatest(0, CAST(trunc((fde - target) * 0.03E0) AS BIGINT)) END AS split_rent FROM p1),
p3 AS (SELECT *, split_rent + CAST(trunc(split_deposit * 0.03E0) AS BIGINT) AS split_cost, mr + CAST(trunc(md * 0.03E0) AS BIGINT) AS goal FROM p2),
p4 AS (SELECT *, CASE WHEN goal IS NOT NULL THEN split_cost / goal WHEN mr IS NOT NULL THEN split_rent / mr WHEN md IS NOT NULL THEN split_deposit / md END AS ratio FROM p3
  WHERE (len(area_keys) = 0 OR coalesce(list_has_any(inside_keys, area_keys), false)) AND (min_area IS NULL OR area_sqm >= min_area * (1 - 0.08E0)) AND (max_area IS NULL OR area_sqm <= max_area * (1 + 0.08E0))
  AND (md IS NULL OR split_deposit <= md * 1.2E0) AND (mr IS NULL OR split_rent <= mr * 1.2E0) AND (goal IS NULL OR split_cost <= 1.2E0 * goal)),
pc AS (SELECT t.*, CASE WHEN workplace_lat IS NOT NULL AND workplace_lon IS NOT NULL THEN CASE commute_mode WHEN 'walk' THEN {_WALK} WHEN 'drive' THEN 6371 * 2 * atan2(sqrt({_HAV}), sqrt(1 - ({_HAV}))) / 22 * 60 * {_JAM} ELSE least({_WALK}, coalesce(net.net, {_WALK})) END END AS commute_mins,
  CASE WHEN w.embedding IS NOT NULL AND v.embedding IS NOT NULL THEN least(1E0, greatest(0E0, list_cosine_similarity(CAST(w.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))) END AS alike
  FROM p4 t LEFT JOIN net ON net.search_id = t.search_id AND net.id = t.id CROSS JOIN nv LEFT JOIN embeddings w ON w.vec_id = t.soft_vec LEFT JOIN embeddings v ON v.vec_id = t.ingest_seq % nv AND t.soft_vec IS NOT NULL),
p5 AS (SELECT *, CASE WHEN ratio IS NULL THEN city_tmc / (city_tmc + {TMC}) WHEN ratio <= 1 THEN 1 - 0.2E0 * ratio ELSE 0.8E0 * exp(-5E0 * (ratio - 1)) END AS u_budget,
  CASE WHEN {TMC} <= 0 THEN 1E0 ELSE least(1E0, baseline / ({TMC} / area_sqm) / 1.2E0) END AS u_value,
  CASE WHEN (min_area IS NULL AND max_area IS NULL) OR (max_area IS NULL AND area_sqm >= min_area) THEN 1E0 ELSE greatest(0E0, 1 - pow(abs(area_sqm - coalesce((min_area + max_area) / 2, max_area, min_area)) / coalesce((min_area + max_area) / 2, max_area, min_area), 1.5E0)) END AS u_area,
  ({_GOT}) / ({_TOTAL}) AS u_amenity, 1 / (1 + exp(0.25E0 * (metro_walk_mins - 8))) AS u_metro, CASE WHEN commute_mins IS NULL THEN 1E0 ELSE 1 / (1 + exp(0.2E0 * (commute_mins - max_commute))) END AS u_commute, exp(-building_age / 15E0) AS u_freshness, coalesce(alike, 1E0) AS u_soft,
  1 - least(0.85E0, CASE WHEN wants_elevator THEN 0.6E0 ELSE 0.3E0 END * least(2E0, greatest(0.5E0, w_amenity / 0.09E0))) * CASE WHEN has_elevator OR floor <= 1 THEN 0E0 ELSE least(1E0, (floor - 1) / 6E0) END AS elevator_penalty FROM pc),
p6 AS (SELECT *, elevator_penalty * CASE WHEN floor < 0 THEN 0.8E0 ELSE 1E0 END AS penalty, ({" + ".join(f"w_{k} * u_{k}" for k in search.UTILITIES)}) * (elevator_penalty * CASE WHEN floor < 0 THEN 0.8E0 ELSE 1E0 END) AS score FROM p5),
ranked AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY round(score, 9) DESC, id) AS rank FROM p6 WHERE score >= 0.45E0)"""


def _scored_query(name: str, columns: dict) -> None:
    """A projection of the pairs that pass, by search and listing."""
    exprs = ", ".join(f"round({c}, 6) AS {c}" if rounded else c for c, rounded in columns.items())
    query(name, f"{SEARCH_CTE} SELECT search_id, id, {exprs} FROM p6")(lambda s, d: scored(s, d).select("search_id", "id", *[F.round(c, 6).alias(c) if rounded else F.col(c) for c, rounded in columns.items()]))


@query("resolve_weights", f"{T.with_tables('intents')}, {WEIGHTS_CTE} SELECT search_id, {', '.join(f'round(w_{k}, 9) AS w_{k}' for k in search.UTILITIES)} FROM wn")
def _(spark, d):
    return search.weights(T.intents(spark)).select("search_id", *[F.round(f"w_{k}", 9).alias(f"w_{k}") for k in search.UTILITIES])


@query("prefilter", f"{SEARCH_CTE} SELECT search_id, id FROM p0")
def _(spark, d):
    return search.candidates(market_of(spark, d), saved_searches(spark, d)).select("search_id", "id")


_scored_query("tabdil_resolve", {"split_deposit": False, "split_rent": False})
_scored_query("hard_mask", {"deposit": False, "rent": False})
for _k in search.UTILITIES:
    _scored_query(f"u_{'financial' if _k == 'budget' else _k}", {f"u_{_k}": True})
_scored_query("elevator_penalty", {"elevator_penalty": True})
_scored_query("structural_penalty", {"penalty": True})
_scored_query("score", {"score": True, **{f"u_{k}": True for k in search.UTILITIES}})


@query("budget_ratio", f"{SEARCH_CTE} SELECT search_id, id, round(ratio, 9) AS ratio FROM p4")
def _(spark, d):
    ratio = money.budget_ratio(F.col("split_deposit"), F.col("split_rent"), F.col("max_deposit"), F.col("max_rent"))
    return scored(spark, d).select("search_id", "id", F.round(ratio, 9).alias("ratio"))


@query("rank", f"{SEARCH_CTE} SELECT search_id, rank, id, round(score, 6) AS score FROM ranked")
def _(spark, d):
    """Whole rankings."""
    return search.rank_all(passing(spark, d).select("search_id", "id", "score")).select("search_id", "rank", "id", F.round("score", 6).alias("score"))


@query("page", f"{SEARCH_CTE} SELECT search_id, rank, id, round(score, 3) AS score, split_deposit, split_rent FROM ranked WHERE rank BETWEEN 1 AND 20")
def _(spark, d):
    return search.page(ranked(spark, d), 1, 20).select("search_id", "rank", "id", F.round("score", 3).alias("score"), "split_deposit", "split_rent")


@query("page_deep", f"{SEARCH_CTE} SELECT search_id, rank, id, round(score, 3) AS score FROM ranked WHERE rank BETWEEN 781 AND 800")
def _(spark, d):
    """A page far behind what is stored: tasks pass on as many rows of a search as stand before its end, no more."""
    return search.page(ranked(spark, d, 800), 40, 20).select("search_id", "rank", "id", F.round("score", 3).alias("score"))


@query("ranked_store", f"{SEARCH_CTE} SELECT search_id, rank, id, round(score, 6) AS score FROM ranked WHERE rank <= 600")
def _(spark, d):
    """Pages come from the stored rankings, which are written once."""
    return kept(spark, d, "ranked", lambda: ranked(spark, d).select("search_id", "rank", "id", F.round("score", 6).alias("score")))


@query("suggested_split", f"{SEARCH_CTE} SELECT search_id, id, CASE WHEN split_deposit <> deposit THEN split_deposit END AS suggested_deposit, CASE WHEN split_deposit <> deposit THEN split_rent END AS suggested_rent FROM ranked")
def _(spark, d):
    moved = F.col("split_deposit") != F.col("deposit")
    return passing(spark, d).select("search_id", "id", F.when(moved, F.col("split_deposit")).alias("suggested_deposit"), F.when(moved, F.col("split_rent")).alias("suggested_rent"))


@query("total_count", f"{SEARCH_CTE} SELECT search_id, count(*) AS n FROM ranked GROUP BY search_id")
def _(spark, d):
    return scored(spark, d).filter(F.col("score") >= C.LEAST_SCORE).groupBy("search_id").agg(F.count(F.lit(1)).alias("n"))


@query("head_reference", f"{SEARCH_CTE} SELECT search_id, round(median(area_sqm), 6) AS head_area, round(median(metro_walk_mins), 6) AS head_metro FROM ranked WHERE rank <= 60 GROUP BY search_id")
def _(spark, d):
    return search.head_reference(ranked(spark, d, C.HEAD_ROWS)).select("search_id", F.round("head_area", 6).alias("head_area"), F.round("head_metro", 6).alias("head_metro"))


@query("pareto_flag", f"""{SEARCH_CTE}, t AS (SELECT DISTINCT search_id, split_cost AS x, metro_walk_mins AS y, area_sqm AS z FROM ranked),
sky AS (SELECT * FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.search_id = a.search_id AND b.x <= a.x AND b.y <= a.y AND b.z >= a.z AND (b.x < a.x OR b.y < a.y OR b.z > a.z)))
SELECT r.search_id, r.id FROM ranked r JOIN sky ON sky.search_id = r.search_id AND x = split_cost AND y = metro_walk_mins AND z = area_sqm""")
def _(spark, d):
    rows = scored(spark, d).filter(F.col("score") >= C.LEAST_SCORE).withColumn("cost", money.tmc(F.col("split_deposit"), F.col("split_rent")))
    return pareto.skyline(rows.select("search_id", "id", "cost", "metro_walk_mins", "area_sqm")).select("search_id", "id")


_OVER = "round_even((ratio - 1) * 100, 0)"
_EXTRA = "(metro_walk_mins - head_metro)"
_FA = "translate(CAST(CAST({} AS BIGINT) AS VARCHAR), '0123456789', '۰۱۲۳۴۵۶۷۸۹')"
_S = search.TRADE_WORDS


@query("trade_off", f"""{SEARCH_CTE}, head AS (SELECT search_id, median(area_sqm) AS head_area, median(metro_walk_mins) AS head_metro FROM ranked WHERE rank <= 60 GROUP BY 1),
t AS (SELECT *, ratio IS NOT NULL AND w_budget >= 0.08E0 AS mc, w_metro >= 0.08E0 AS wc FROM ranked JOIN head USING (search_id) WHERE rank > 60 AND (area_sqm - head_area) / head_area >= 0.25E0)
SELECT search_id, id, '{_S["this"]}' || concat_ws('{_S["and"]}', {_FA.format('round_even(area_sqm - head_area, 0)')} || '{_S["larger"]}', CASE WHEN mc AND {_OVER} <= 0 THEN '{_S["in_budget"]}' END, CASE WHEN wc AND round_even({_EXTRA}, 0) <= 0 THEN '{_S["near_metro"]}' END)
|| CASE WHEN (mc AND {_OVER} > 0) OR (wc AND round_even({_EXTRA}, 0) > 0) THEN '{_S["but"]}' || concat_ws('{_S["and"]}', CASE WHEN mc AND {_OVER} > 0 THEN {_FA.format(_OVER)} || '{_S["over_budget"]}' END, CASE WHEN wc AND round_even({_EXTRA}, 0) > 0 THEN {_FA.format(f'round_even({_EXTRA}, 0)')} || '{_S["longer_walk"]}' END) ELSE '' END || '.' AS sentence
FROM t WHERE (mc OR wc) AND (NOT mc OR {_OVER} <= 10) AND (NOT wc OR round_even({_EXTRA}, 0) <= 0 OR {_EXTRA} <= 7)""")
def _(spark, d):
    """Of all ranks below the head."""
    head = cut(ranked(spark, d, C.HEAD_ROWS).select("search_id", "id", "rank", "area_sqm", "metro_walk_mins"))
    return search.trade_off(search.below_head(passing(spark, d), head), head)


@query("result_row", f"{SEARCH_CTE} SELECT search_id, id, rank, area_key, area_sqm, rooms, floor, total_floors, build_year, deposit, rent, split_deposit, split_rent, image_count, CASE WHEN image_count > 0 THEN id || '-1.jpg' END AS thumbnail, round_even(metro_walk_mins, 3) AS walk, round_even(commute_mins, 3) AS commute, round_even(score, 3) AS score, {', '.join(f'round_even(u_{k}, 3) AS u_{k}' for k in search.UTILITIES)} FROM ranked")
def _(spark, d):
    images = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("image_count")), lambda i: F.concat(F.col("id"), F.lit("-"), i.cast("string"), F.lit(".jpg")))
    shown = F.try_element_at(F.when(F.col("image_count") > 0, images), F.lit(1))
    rounded = [F.bround(c, 3).alias(n) for c, n in [("metro_walk_mins", "walk"), ("commute_mins", "commute"), ("score", "score"), *((f"u_{k}", f"u_{k}") for k in search.UTILITIES)]]
    columns = "search_id id score area_key area_sqm rooms floor total_floors build_year deposit rent split_deposit split_rent image_count metro_walk_mins commute_mins".split()
    rows = search.rank_all(passing(spark, d).select(*columns, *[f"u_{k}" for k in search.UTILITIES]))
    return rows.select("search_id", "id", "rank", "area_key", "area_sqm", "rooms", "floor", "total_floors", "build_year", "deposit", "rent", "split_deposit", "split_rent", "image_count", shown.alias("thumbnail"), *rounded)


#: The viewport of each search's map; some searches have none.
MAP_VIEWS = ((1, 35.6, 35.75, 51.2, 51.5, 12.0), (2, 35.69, 35.72, 51.38, 51.43, 17.0), (4, 35.55, 35.85, 51.1, 51.6, 11.0), (9, 35.7, 35.7, 51.4, 51.4, 10.0))
_MAP = "v AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a}E0, {b}E0, {c}E0, {e}E0, {z}E0)" for k, a, b, c, e, z in MAP_VIEWS) + ") t(search_id, min_lat, max_lat, min_lon, max_lon, zoom))"


@query("map_mode", f"{SEARCH_CTE}, {_MAP}, spots AS (SELECT search_id, id, lat, lon FROM p4), {SHOWN} SELECT {SHOWN_COLUMNS} FROM shown")
def _(spark, d):
    """Unranked: all that passes the hard conditions."""
    views = spark.createDataFrame(list(MAP_VIEWS), "search_id bigint, min_lat double, max_lat double, min_lon double, max_lon double, zoom double")
    return show(search.with_split(search.candidates(market_of(spark, d), saved_searches(spark, d))).filter(search.hard_mask()), views)


@query("refresh_metro_walk", f"{T.with_tables('listings', 'stations')}, {NEAREST} SELECT id, round(meters, 4) AS meters, round(meters / 80, 4) AS walk_mins FROM nearest")
def _(spark, d):
    """The stored columns as they are after a change of the stations: taken anew for every home, from where it stands alone."""
    fresh = spatial.with_nearest(T.listings(spark, d).select("id", "lat", "lon"), T.stations(spark, d).filter("type = 'metro'"), "metro_id", "metro_meters", "station_id")
    return fresh.select("id", F.round("metro_meters", 4).alias("meters"), F.round(F.col("metro_meters") / C.WALK_M_PER_MIN, 4).alias("walk_mins"))
