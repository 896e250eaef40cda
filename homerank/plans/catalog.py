"""One query for each operator, with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import geo, money, repair, text
from ..operators import corpus, market, search, spatial
from ..sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

R = "0.03E0"
TMC = "(rent + CAST(trunc(deposit * 0.03E0) AS BIGINT))"
FDE = "CAST(trunc(deposit + rent / 0.03E0) AS BIGINT)"
FOLD = "translate({}, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789')"
_COLLAPSED = "trim(regexp_replace(translate({}, 'يك', 'یک'), '\\s+', ' ', 'g'))"
NORM = "array_to_string([CASE WHEN w = 'اباد' THEN 'آباد' ELSE w END for w in string_split(" + _COLLAPSED + ", ' ')], ' ')"
PREPARED = NORM.format(FOLD.format("coalesce({}, '')"))


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _six(column, name: str):
    return F.round(column, 6).alias(name)


def _listing_query(name: str, columns, sql: str, keep: str = "id") -> None:
    """A projection of the listings."""
    query(name, f"{T.with_tables('listings')} SELECT {keep}, {sql} FROM listings")(lambda s, d: T.listings(s, d).select(keep, *columns()))


def _text_query(name: str, columns, sql: str) -> None:
    """A projection of the adverts' texts."""
    query(name, f"{T.with_tables('adverts')} SELECT k, {sql} FROM adverts")(lambda s, d: T.adverts(s, d).select("k", *columns()))


# Money.
_listing_query("tmc", lambda: [money.tmc(F.col("deposit"), F.col("rent")).alias("tmc")], f"{TMC} AS tmc")
_listing_query("fde", lambda: [money.fde(F.col("deposit"), F.col("rent")).alias("fde")], f"{FDE} AS fde")
_listing_query("full_deposit_flag", lambda: [money.is_full_deposit(F.col("rent")).alias("is_full_deposit")], "rent <= 100000 AS is_full_deposit")
_listing_query(
    "budget_compatible", lambda: [money.budget_compatible(F.col("deposit"), F.col("rent"), F.lit(200_000_000), F.col("convertible_deposit_max") % 20_000_000).alias("fits")],
    f"{TMC} <= 1.15E0 * (coalesce(convertible_deposit_max % 20000000, 0) + 6000000) AS fits",
)
_listing_query("placeholder_price", lambda: [money.is_placeholder(F.col("deposit"), F.col("rent"), F.col("area_sqm")).alias("placeholder")], "trunc(rent + deposit * 0.03E0) < 1000000 OR trunc(rent + deposit * 0.03E0) / area_sqm < 100000 AS placeholder")
BAND = "CASE WHEN can_convert THEN least(CAST(trunc(0.2E0 * {fde}) AS BIGINT), deposit) ELSE deposit END AS lower_deposit, CASE WHEN can_convert THEN greatest(coalesce(nullif(convertible_deposit_max, 0), {fde}), deposit) ELSE deposit END AS upper_deposit".format(fde=FDE)


def _band_columns():
    low, high = money.band(F.col("deposit"), F.col("rent"), F.col("can_convert"), F.col("convertible_deposit_max"))
    return [low.alias("lower_deposit"), high.alias("upper_deposit")]


_listing_query("tabdil_band", _band_columns, BAND)


@query("purge_placeholder", f"{T.with_tables('listings')} SELECT id, deposit, rent FROM listings WHERE NOT (trunc(rent + deposit * 0.03E0) < 1000000 OR trunc(rent + deposit * 0.03E0) / area_sqm < 100000)")
def _(spark, d):
    return T.listings(spark, d).filter(~money.is_placeholder(F.col("deposit"), F.col("rent"), F.col("area_sqm"))).select("id", "deposit", "rent")


# Text.
_text_query("digits_fold", lambda: [text.digits_fold(F.col("title")).alias("folded")], FOLD.format("title") + " AS folded")
_text_query("digits_persian", lambda: [text.digits_persian(F.col("k")).alias("shown")], "translate(CAST(k AS VARCHAR), '0123456789', '۰۱۲۳۴۵۶۷۸۹') AS shown")
_text_query("text_normalize", lambda: [text.normalize(F.col("title")).alias("plain")], NORM.format("title") + " AS plain")
_text_query("crawl_normalize", lambda: [text.crawl_normalize(F.col("title")).alias("plain")], f"translate({FOLD.format('title')}, 'يكئ', 'یکی') AS plain")
_MATCH = NORM.format("translate(replace(title, chr(8204), ' '), 'آأإٱئؤةۀء', 'اااایوهه')")
_text_query("match_form", lambda: [text.match_form(F.col("title")).alias("form")], f"{_MATCH} AS form")
_text_query("squash_form", lambda: [text.squash_form(F.col("title")).alias("form")], f"replace({_MATCH}, ' ', '') AS form")
_text_query("first_integer", lambda: [text.first_integer(F.col("title")).alias("n")], f"TRY_CAST(regexp_replace({FOLD.format('title')}, '[^0-9]', '', 'g') AS BIGINT) AS n")
_P = PREPARED.format("title")
_PD = PREPARED.format("concat_ws(' ', title, description)")
_text_query(
    "mine_rooms", lambda: [text.mine_rooms(text.prepared(F.col("title"))).alias("rooms")],
    f"CASE WHEN regexp_matches({_P}, '{text.NO_ROOM}') THEN 0 WHEN regexp_extract({_P}, '{text.ROOM_DIGITS}', 1) <> '' THEN CASE WHEN CAST(regexp_extract({_P}, '{text.ROOM_DIGITS}', 1) AS INT) BETWEEN 0 AND 10 THEN CAST(regexp_extract({_P}, '{text.ROOM_DIGITS}', 1) AS INT) END "
    + "ELSE CASE regexp_extract(" + _P + ", '" + text.ROOM_WORD + "', 1) " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in text.ROOM_WORDS.items()) + " END END AS rooms",
)
_text_query(
    "mine_floor_pair", lambda: [text.mine_floor(text.prepared(F.col("title"))).alias("floor"), text.mine_floor_total(text.prepared(F.col("title"))).alias("total_floors")],
    f"CASE WHEN regexp_extract({_P}, '{text.FLOOR_OF}', 1) <> '' THEN CAST(regexp_extract({_P}, '{text.FLOOR_OF}', 1) AS INT) WHEN regexp_matches({_P}, '^-?[0-9]+$') THEN TRY_CAST({_P} AS INT) WHEN contains({_P}, 'همکف') THEN 0 WHEN contains({_P}, 'زیرزمین') THEN -1 END AS floor, TRY_CAST(regexp_extract({_P}, '{text.FLOOR_OF}', 2) AS INT) AS total_floors",
)
_text_query(
    "mine_total_floors", lambda: [text.mine_total_floors(_pd()).alias("total_floors")],
    f"list_filter(list_transform(list_zip(regexp_extract_all({_PD}, '{text.TOTAL_FLOORS}', 1), regexp_extract_all({_PD}, '{text.TOTAL_FLOORS}', 2)), lambda p: coalesce(TRY_CAST(p[1] AS INT), TRY_CAST(p[2] AS INT))), lambda x: x BETWEEN 1 AND 40)[1] AS total_floors",
)
_text_query("mine_area", lambda: [text.mine_area(_pd()).alias("area")], f"[x for x in [CAST(m AS INT) for m in regexp_extract_all({_PD}, '{text.AREA}', 1)] if x BETWEEN 15 AND 2000][1] AS area")


_MENTIONED = {"has_balcony": text.BALCONY, "can_convert": text.CONVERTIBLE}


def _pd():
    return text.prepared(F.concat_ws(" ", "title", "description"))


_text_query(
    "mention_tristate", lambda: [text.mentions(_pd(), *lists).alias(name) for name, lists in _MENTIONED.items()],
    ", ".join(f"CASE WHEN regexp_matches({_PD}, '{'|'.join(no)}') THEN false WHEN regexp_matches({_PD}, '{'|'.join(yes)}') THEN true END AS {name}" for name, (yes, no) in _MENTIONED.items()),
)
#: The rules stated again, for RE2: its own patterns, so that a slip in the library's does not agree with itself.
_LINE = "regexp_replace(" + NORM + ", '[' || chr(8204) || ' ]+', ' ', 'g')"
_L, _LD = _LINE.format("coalesce(title, '')"), _LINE.format("concat_ws(' ', title, description)")
_SHARED_WORDS = (
    "هم ?(خانه|خونه|اتاقی|منزل|سکونت)", "خوابگاه", "پانسیون", "اجاره ?(ی ?)?(یک ?)?اتاق", "اتاق ?(برای ?)?اجاره", "یک ?اتاق ?[0-9۰-۹]+ ?متر", "اتاق ?مبله", "(اجاره|رزرو) ?تخت", "تخت ?خواب ?اجاره",
)
_CAR = "پار(ک|گ)ین(ک|گ)"
_CAR_WORDS = (f"(^|[ /،,-])(اجاره|رهن|کرایه|واگذاری) *([^ ]+ +)?([^ ]+ +)?([^ ]+ +)?{_CAR}", f"^ *{_CAR}", f"{_CAR} *(اجاره|کرایه)", f"^ *([^ 0-9۰-۹]+ +)?{_CAR} *$")
_HOME_WORDS = ("خواب", "(آ|ا)پارتمان", "سوی(ی|ئ)ت", "مغازه", "دفتر", "طبقه", "منزل", "ویلا", "خانه", "اتاق", "متری", "واحد([^یي]|$)", "متر([^آ-ی]|$)")
_any = lambda line, words: "(" + " OR ".join(f"regexp_matches({line}, '{w}')" for w in words) + ")"
_SHARED = _any(_LD, _SHARED_WORDS)
_PARK = f"({_any(_L, _CAR_WORDS)} AND NOT {_any(_L, _HOME_WORDS)})"
_text_query("is_shared_living", lambda: [text.is_shared_living(F.col("title"), F.col("description")).alias("shared")], f"{_SHARED} AS shared")
_text_query("is_parking_rental", lambda: [text.is_parking_rental(F.col("title")).alias("parking")], f"{_PARK} AS parking")
_text_query("is_not_a_home", lambda: [text.is_not_a_home(F.col("title"), F.col("description")).alias("not_a_home")], f"({_SHARED} OR {_PARK}) AS not_a_home")
_text_query("search_text", lambda: [text.search_text(F.col("title"), F.col("description")).alias("search_text")], f"{_PD} AS search_text")


@query("drop_promo_lines", "SELECT doc_id, nullif(array_to_string([trim(x) for x in string_split(text, chr(10)) if trim(x) <> '' AND NOT starts_with(trim(x), 'All rights')], chr(10)), '') AS body FROM documents")
def _(spark, d):
    return T.table(spark, d, "documents").select("doc_id", text.drop_promo_lines(F.col("text"), "All rights").alias("body"))


# Repairs; some of the fields are taken out first.
def _gap(column: str, every: int) -> Column:
    return F.when(F.col("ingest_seq") % every != 0, F.col(column))


_listing_query(
    "repair_area", lambda: [repair.repair_area(F.when(F.col("ingest_seq") % 13 == 0, F.lit(115115)).otherwise(_gap("area_sqm", 11)), F.when(F.col("ingest_seq") % 2 == 0, F.lit(70))).alias("area")],
    "CASE WHEN ingest_seq % 13 = 0 THEN CASE WHEN ingest_seq % 2 = 0 THEN 70 ELSE 2000 END WHEN ingest_seq % 11 = 0 THEN CASE WHEN ingest_seq % 2 = 0 THEN 70 END ELSE area_sqm END AS area",
)
_listing_query("estimate_rooms", lambda: [repair.rooms_or_estimate(_gap("rooms", 3), F.col("area_sqm")).alias("rooms")], "CASE WHEN ingest_seq % 3 <> 0 THEN rooms ELSE greatest(1, least(5, CAST(round_even(area_sqm / 40, 0) AS BIGINT))) END AS rooms")
_listing_query(
    "resolve_floors", lambda: [c.alias(n) for c, n in zip(repair.resolve_floors(_gap("floor", 5), F.col("total_floors") - F.col("ingest_seq") % 3), ("floor", "total_floors"))],
    "CASE WHEN ingest_seq % 5 <> 0 THEN floor ELSE 0 END AS floor, greatest(total_floors - ingest_seq % 3, CASE WHEN total_floors - ingest_seq % 3 >= CASE WHEN ingest_seq % 5 <> 0 THEN floor ELSE 0 END THEN -9 ELSE greatest(CASE WHEN ingest_seq % 5 <> 0 THEN floor ELSE 0 END, 1) END) AS total_floors",
)
_listing_query(
    "clamp_to_bbox", lambda: [repair.clamp(F.col("lat") + 0.1, C.CITY["min_lat"], C.CITY["max_lat"]).alias("lat"), repair.clamp(F.col("lon") - 0.2, C.CITY["min_lon"], C.CITY["max_lon"]).alias("lon")],
    "greatest(35.55E0, least(35.85E0, lat + 0.1E0)) AS lat, greatest(51.1E0, least(51.6E0, lon - 0.2E0)) AS lon",
)


# Geography.
MAN = "abs({a}.lat - {b}.lat) * 111320 + abs({a}.lon - {b}.lon) * 111320 * cos(radians(({a}.lat + {b}.lat) / 2))"
_listing_query("grid_cell", lambda: [geo.cell(F.col("lat")).alias("cell_row"), geo.cell(F.col("lon")).alias("cell_col")], "CAST(floor(lat / 0.01E0) AS BIGINT) AS cell_row, CAST(floor(lon / 0.01E0) AS BIGINT) AS cell_col")
_listing_query(
    "haversine_km", lambda: [_six(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(35.7), F.lit(51.4)), "km")],
    "round(6371 * 2 * atan2(sqrt(pow(sin(radians(35.7E0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(35.7E0)) * pow(sin(radians(51.4E0 - lon) / 2), 2)), sqrt(1 - (pow(sin(radians(35.7E0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(35.7E0)) * pow(sin(radians(51.4E0 - lon) / 2), 2)))), 6) AS km",
)
_listing_query("manhattan_m", lambda: [F.round(geo.manhattan_m(F.col("lat"), F.col("lon"), F.lit(35.7), F.lit(51.4)), 4).alias("m")], "round(abs(lat - 35.7E0) * 111320 + abs(lon - 51.4E0) * 111320 * cos(radians((lat + 35.7E0) / 2)), 4) AS m")
_listing_query("zone_flags", lambda: [geo.in_box(F.col("lat"), F.col("lon"), C.ZONE).alias("in_zone")], "lat BETWEEN 35.7E0 AND 35.735E0 AND lon BETWEEN 51.39E0 AND 51.435E0 AS in_zone")
INSIDE = "listings l JOIN areas a ON l.lat BETWEEN a.min_lat AND a.max_lat AND l.lon BETWEEN a.min_lon AND a.max_lon JOIN edges e USING (area_key) GROUP BY l.id, a.area_key, a.ord HAVING sum(CASE WHEN (e.y1 > l.lat) <> (e.y2 > l.lat) AND l.lon < (e.x2 - e.x1) * (l.lat - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1 THEN 1 ELSE 0 END) % 2 = 1"
GEO_CTE = T.with_tables("listings", "area_base", "areas", "edges") + f", hits AS (SELECT l.id, a.area_key, a.ord FROM {INSIDE}), located AS (SELECT id, arg_min(area_key, ord) AS area_key, list(area_key ORDER BY ord) AS inside_keys FROM hits GROUP BY id)"


@query("bbox_filter", f"{T.with_tables('listings')} SELECT id, lat, lon FROM listings WHERE lat BETWEEN 35.7E0 AND 35.735E0 AND lon BETWEEN 51.39E0 AND 51.435E0")
def _(spark, d):
    return T.listings(spark, d).filter(geo.in_box(F.col("lat"), F.col("lon"), C.ZONE)).select("id", "lat", "lon")


@query("pip_first", f"{GEO_CTE} SELECT id, area_key FROM listings LEFT JOIN located USING (id)")
def _(spark, d):
    return spatial.first_polygon(T.listings(spark, d), T.areas(spark, d))


@query("pip_any", f"{GEO_CTE} SELECT id FROM hits WHERE area_key IN ('a7', 'a12') GROUP BY id")
def _(spark, d):
    return spatial.within_any(T.listings(spark, d), T.areas(spark, d).filter(F.col("area_key").isin("a7", "a12"))).select("id")


@query("area_sqkm", f"{T.with_tables('area_base', 'areas', 'edges')} SELECT area_key, round(abs(sum(x1 * y2 - x2 * y1)) / 2 * 111.32E0 * 111.32E0 * cos(radians(any_value(center_lat))), 3) AS sqkm FROM areas JOIN edges USING (area_key) GROUP BY area_key")
def _(spark, d):
    return T.areas(spark, d).select("area_key", F.round(geo.ring_sqkm("ring", F.col("center_lat")), 3).alias("sqkm"))


NEAREST = f"nearest AS (SELECT l.id, min({MAN.format(a='l', b='s')}) AS meters FROM listings l, stations s WHERE s.type = 'metro' GROUP BY l.id)"


@query("nearest_station", f"{T.with_tables('listings', 'stations')}, {NEAREST} SELECT id, round(meters, 4) AS meters, round(meters / 80, 4) AS walk_mins FROM nearest")
def _(spark, d):
    found = spatial.nearest(T.listings(spark, d), T.stations(spark, d).filter("type = 'metro'"))
    return found.select("id", F.round("meters", 4).alias("meters"), F.round(F.col("meters") / C.WALK_M_PER_MIN, 4).alias("walk_mins"))


@query("radius_join", f"{T.with_tables('listings', 'stations')} SELECT l.id, s.station_id, round({MAN.format(a='l', b='s')}, 3) AS meters FROM listings l, stations s WHERE {MAN.format(a='l', b='s')} <= 1500")
def _(spark, d):
    return spatial.within_radius(T.listings(spark, d), T.stations(spark, d), 1500.0).withColumn("meters", geo.to_millimeters(F.col("meters")))


@query("src_stations", f"{T.with_tables('stations')} SELECT station_id, unnest(list_filter([line, second_line], lambda x: x IS NOT NULL)) AS line FROM stations")
def _(spark, d):
    return T.stations(spark, d).select("station_id", F.explode_outer(F.array_compact(F.array("line", "second_line"))).alias("line")).select("station_id", F.coalesce("line", F.concat(F.lit("_"), F.col("station_id").cast("string"))).alias("line"))


#: Viewports: the middle of the city, a street corner seen from near, and one without an extent.
VIEWS = ((1, 35.6, 35.75, 51.2, 51.5, 12.0), (2, 35.69, 35.72, 51.38, 51.43, 17.0), (3, 35.7, 35.7, 51.4, 51.4, 10.0))
_VIEWS = "v AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a}E0, {b}E0, {c}E0, {e}E0, {z}E0)" for k, a, b, c, e, z in VIEWS) + ") t(search_id, min_lat, max_lat, min_lon, max_lon, zoom))"
#: From spots (search_id, id, lat, lon) and v: what a map shows.
SHOWN = """spots2 AS (SELECT spots.*, min_lat, max_lat, min_lon, max_lon, zoom, greatest(max_lat - min_lat, 1e-9) AS dy, greatest(max_lon - min_lon, 1e-9) AS dx FROM spots JOIN v USING (search_id) WHERE lat BETWEEN min_lat AND max_lat AND lon BETWEEN min_lon AND max_lon),
spots3 AS (SELECT *, greatest(0, least(2, CAST(floor((lat - min_lat) / dy * 3) AS BIGINT))) AS row, greatest(0, least(3, CAST(floor((lon - min_lon) / dx * 4) AS BIGINT))) AS col FROM spots2),
cells AS (SELECT search_id, row, col, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon, any_value(min_lat) AS y, any_value(min_lon) AS x, any_value(dy) AS dy, any_value(dx) AS dx, any_value(zoom) AS zoom FROM spots3 GROUP BY ALL),
opened AS (SELECT *, (n <= 30 OR zoom >= 16) AND sum(n) OVER (PARTITION BY search_id ORDER BY n, row, col) <= 400 AS open FROM cells),
shown AS (SELECT search_id, 'cluster' AS kind, NULL AS id, row, col, n, lat, lon, y + row * dy / 3 AS south, y + (row + 1) * dy / 3 AS north, x + col * dx / 4 AS west, x + (col + 1) * dx / 4 AS east FROM opened WHERE NOT open
UNION ALL SELECT search_id, 'pin', spots3.id, row, col, 1, spots3.lat, spots3.lon, NULL, NULL, NULL, NULL FROM spots3 JOIN opened USING (search_id, row, col) WHERE open
UNION ALL SELECT search_id, 'pin', id, NULL, NULL, 1, lat, lon, NULL, NULL, NULL, NULL FROM spots WHERE search_id NOT IN (SELECT search_id FROM v) QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY id) <= 400)"""
SHOWN_COLUMNS = "search_id, kind, id, row, col, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("lat", "lon", "south", "north", "west", "east"))


def show(points: DataFrame, views: DataFrame) -> DataFrame:
    out = spatial.clusters_and_pins(points.select("search_id", "id", "lat", "lon"), views.select("search_id", "min_lat", "max_lat", "min_lon", "max_lon"), views)
    return out.select("search_id", "kind", "id", "row", "col", "n", *[_six(F.col(c), c) for c in ("lat", "lon", "south", "north", "west", "east")])


def views(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VIEWS), "search_id bigint, min_lat double, max_lat double, min_lon double, max_lon double, zoom double")


@query("map_clusters", f"{T.with_tables('listings')}, {_VIEWS}, spots AS (SELECT search_id, id, lat, lon FROM listings, v), {SHOWN} SELECT {SHOWN_COLUMNS} FROM shown")
def _(spark, d):
    each = views(spark)
    return show(search.against_all(T.listings(spark, d).select("id", "lat", "lon"), each.select("search_id")), each)


# Market.
MARKET_CTE = GEO_CTE + f", placed AS (SELECT l.*, area_key, inside_keys FROM listings l LEFT JOIN located USING (id)), base AS (SELECT area_key, median({TMC} / area_sqm) AS baseline, count(*) AS n FROM placed WHERE area_key IS NOT NULL GROUP BY area_key HAVING count(*) >= 5), city AS (SELECT median({TMC} / area_sqm) AS city_per_sqm, median({TMC}) AS city_tmc FROM placed)"


def _placed(spark, d) -> DataFrame:
    """The listings with inside_keys and area_key."""
    return spatial.with_polygons(T.listings(spark, d), T.areas(spark, d)).withColumn("area_key", F.try_element_at("inside_keys", F.lit(1)))


@query("market_baselines", f"{MARKET_CTE} SELECT area_key, round(baseline, 6) AS baseline, n FROM base")
def _(spark, d):
    return market.area_baselines(_placed(spark, d)).withColumn("baseline", F.round("baseline", 6))


FLOORS = f"c AS (SELECT CAST(floor(lat / 0.05E0) AS BIGINT) AS cell_row, CAST(floor(lon / 0.05E0) AS BIGINT) AS cell_col, {TMC} / area_sqm AS x, id, deposit, rent FROM listings), m AS (SELECT cell_row, cell_col, median(x) AS m, count(*) AS n FROM c GROUP BY 1, 2 HAVING count(*) >= 12), floors AS (SELECT cell_row, cell_col, greatest(0.12E0 * any_value(m), least(any_value(m) - 3 * median(abs(x - m)), 0.35E0 * any_value(m))) AS price_floor, any_value(n) AS n FROM c JOIN m USING (cell_row, cell_col) GROUP BY 1, 2)"


@query("local_price_floors", f"{T.with_tables('listings')}, {FLOORS} SELECT cell_row, cell_col, round(price_floor, 4) AS price_floor, n FROM floors")
def _(spark, d):
    return market.price_floors(T.listings(spark, d), 0.05).withColumn("price_floor", F.round("price_floor", 4))


@query("local_price_outlier", f"{T.with_tables('listings')}, {FLOORS} SELECT id, deposit, rent FROM c LEFT JOIN floors USING (cell_row, cell_col) WHERE price_floor IS NULL OR x >= price_floor")
def _(spark, d):
    rows = T.listings(spark, d)
    return market.without_outliers(rows, market.price_floors(rows, 0.05), 0.05).select("id", "deposit", "rent")


NOW = "2030-01-01 00:00:00"


@query("posting_rate", f"SELECT user_id, count(*) AS posts, round(count(*) / (epoch_us(TIMESTAMP '{NOW}') / 1e6 - epoch_us(min(ts)) / 1e6) * 3600, 9) AS per_hour FROM events GROUP BY user_id")
def _(spark, d):
    return market.posting_rate(T.table(spark, d, "events"), NOW).withColumn("per_hour", F.round("per_hour", 9))


@query("quota_sample", "SELECT event_id, user_id FROM events WHERE event_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5(CAST(event_id AS VARCHAR) || '-7'), event_id) <= 20")
def _(spark, d):
    posts = T.table(spark, d, "events")
    return market.quota_sample(posts, posts.filter("event_id % 3 = 0").select("event_id"), 20, "event_id", "user_id").select("event_id", "user_id")


# Corpus.
_KEY = "concat_ws('|', coalesce(area_key, ''), CAST(area_sqm AS VARCHAR), CAST(rooms AS VARCHAR), CAST(floor AS VARCHAR), CAST(deposit AS VARCHAR), CAST(rent AS VARCHAR), CAST(CAST(floor(lat * 1e5 + 0.5E0) AS BIGINT) AS VARCHAR), CAST(CAST(floor(lon * 1e5 + 0.5E0) AS BIGINT) AS VARCHAR))"


@query("fingerprint", f"{GEO_CTE}, placed AS (SELECT l.*, area_key FROM listings l LEFT JOIN located USING (id)) SELECT id, sha256({_KEY}) AS fingerprint FROM placed")
def _(spark, d):
    return _placed(spark, d).select("id", corpus.fingerprint().alias("fingerprint"))


REPOSTS = "r AS (SELECT id, ingest_seq, concat_ws('|', CAST(deposit AS VARCHAR), CAST(rent AS VARCHAR), CAST(lat AS VARCHAR)) AS fingerprint, rent FROM (SELECT id, ingest_seq, deposit, rent, lat FROM listings UNION ALL SELECT 'r' || id, ingest_seq + 100000000, deposit, rent, lat FROM listings WHERE ingest_seq % 10 = 0))"


def _reposts(spark, d) -> DataFrame:
    rows = T.listings(spark, d)
    again = rows.filter("ingest_seq % 10 = 0").withColumn("id", F.concat(F.lit("r"), "id")).withColumn("ingest_seq", F.col("ingest_seq") + 100_000_000)
    return rows.unionByName(again).select("id", "ingest_seq", F.concat_ws("|", "deposit", "rent", "lat").alias("fingerprint"), "rent")


@query("dedup_first", f"{T.with_tables('listings')}, {REPOSTS} SELECT id, ingest_seq, rent FROM r QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ingest_seq) = 1")
def _(spark, d):
    return corpus.dedup_first(_reposts(spark, d)).select("id", "ingest_seq", "rent")


@query("queue_antijoin", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def _(spark, d):
    posts = T.table(spark, d, "events").select("event_id")
    return posts.join(posts.filter("event_id % 3 = 0"), "event_id", "left_anti")


@query("queue_union", "SELECT DISTINCT user_id FROM events")
def _(spark, d):
    posts = T.table(spark, d, "events")
    return posts.filter("event_id % 2 = 0").select("user_id").union(posts.select("user_id")).distinct()


@query("embeddings_store", "SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE len(embedding) > 0 AND vec_id IN (SELECT o_orderkey FROM orders)")
def _(spark, d):
    known = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("vec_id"))
    return T.table(spark, d, "embeddings").filter(F.size("embedding") > 0).join(known, "vec_id", "left_semi").select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("corpus_load", f"{T.with_tables('listings')} SELECT id, label, round(CAST(embedding[64] AS DOUBLE), 6) AS last FROM listings LEFT JOIN embeddings ON vec_id = ingest_seq")
def _(spark, d):
    vectors = T.table(spark, d, "embeddings")
    rows = T.listings(spark, d)
    return rows.join(vectors, rows.ingest_seq == vectors.vec_id, "left").select("id", "label", F.round(F.get("embedding", F.lit(63)).cast("double"), 6).alias("last"))


@query("lookup_by_id", f"{T.with_tables('listings')} SELECT id, deposit, rent FROM listings WHERE id = 'o-42'")
def _(spark, d):
    """By the key of the stored rows, so that Parquet skips the groups of rows without it."""
    return T.table(spark, d, "orders").filter(F.col("o_orderkey") == 42).selectExpr(*T.LISTING).select("id", "deposit", "rent")


@query("corpus_count", "SELECT count(*) AS n FROM orders")
def _(spark, d):
    return T.listings(spark, d).agg(F.count(F.lit(1)).alias("n"))


# Similarity of vectors: those with an id that hundreds divide, against all.
@query("cosine", "WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0) SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS similarity FROM embeddings, q")
def _(spark, d):
    rows = T.table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("e"))
    return search.cosines(rows, asked).select("query_id", "vec_id", _six(F.col("similarity"), "similarity"))
