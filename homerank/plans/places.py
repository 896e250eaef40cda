"""Queries of names, places, rasters and of searches put together, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import squash_form
from ..operators import names, raster, search, spatial
from ..sources import tables as T
from ..sources.prepared import kept
from .catalog import _six, query

_V = "STRING", "VARCHAR"
#: Areas with names that some share but for a qualifier, sizes and keywords.
NAMED = "'a' || CAST(n_nationkey AS STRING) AS area_key, n_nationkey AS ord, CASE WHEN n_nationkey % 12 = 3 THEN 'Kuhsar (' || CAST(n_nationkey AS STRING) || ')' ELSE 'Place' || CAST(n_nationkey AS STRING) || 'ville' END AS title, n_nationkey * 7 % 25 AS size"
ASKED = "CASE c_custkey % 6 WHEN 0 THEN 'Place' || CAST(c_custkey % 25 AS STRING) || 'ville' WHEN 1 THEN 'Kuhsar' WHEN 2 THEN 'near  Place' || CAST(c_custkey % 25 AS STRING) || 'ville' WHEN 3 THEN 'Street' || CAST(c_custkey % 9 AS STRING) WHEN 4 THEN 'at Market' || CAST(c_custkey % 30 AS STRING) ELSE 'xPlace' || CAST(c_custkey % 25 AS STRING) || 'villex' END"
_NA = f"na AS (SELECT {NAMED} FROM nation), asked AS (SELECT DISTINCT trim(regexp_replace({ASKED}, '\\s+', ' ', 'g')) AS name FROM customer)".replace(*_V)
_STEPS = """words AS (SELECT name, unnest(string_split(name, ' ')) AS w, generate_subscripts(string_split(name, ' '), 1) AS pos FROM asked), w2 AS (SELECT words.name, arg_min(area_key, pos) AS word FROM words JOIN idx ON form = w WHERE length(w) >= 3 GROUP BY 1),
f AS (SELECT asked.name, i.area_key AS whole, word FROM asked LEFT JOIN idx i ON form = replace(asked.name, ' ', '') LEFT JOIN w2 ON w2.name = asked.name),
p AS (SELECT name, arg_min(area_key, ord) AS part FROM f2, inside WHERE length(form) >= 5 AND (contains(needle, form) OR contains(form, needle)) GROUP BY 1), f2 AS (SELECT name, replace(name, ' ', '') AS needle FROM f WHERE whole IS NULL AND word IS NULL)"""
_STEPS = _STEPS.split("p AS (")[0] + "f2 AS" + _STEPS.split("f2 AS")[1] + ", p AS (" + _STEPS.split("p AS (")[1].split(", f2 AS")[0]
_OUT = "SELECT f.name, coalesce(whole, word, part) AS area_key, CASE WHEN whole IS NOT NULL THEN 'whole' WHEN word IS NOT NULL THEN 'word' ELSE 'part' END AS step FROM f LEFT JOIN p ON p.name = f.name WHERE coalesce(whole, word, part) IS NOT NULL"


def named_areas(spark, d) -> DataFrame:
    return T.table(spark, d, "nation").selectExpr(*NAMED.replace(", CASE", ",, CASE").replace(", n_", ",, n_").split(",, ")).withColumn("keywords", F.array(F.concat(F.lit("Street"), (F.col("ord") % 7).cast("string")), F.concat(F.lit("Market"), F.col("ord").cast("string"))))


def asked_names(spark, d) -> DataFrame:
    return T.table(spark, d, "customer").selectExpr(f"trim(regexp_replace({ASKED}, '\\\\s+', ' ')) AS name")


@query("resolve_area_title", f"WITH {_NA}, t AS (SELECT area_key, ord, size, replace(title, ' ', '') AS form, replace(regexp_replace(title, '\\s*\\([^)]*\\)\\s*$', ''), ' ', '') AS bare FROM na), inside AS (SELECT form, arg_max(area_key, ord) AS area_key, max(ord) AS ord FROM t GROUP BY 1), idx AS (SELECT form, area_key FROM inside UNION ALL SELECT bare, arg_max(area_key, size) FROM t WHERE bare NOT IN (SELECT form FROM inside) GROUP BY 1), {_STEPS} {_OUT}")
def _(spark, d):
    return names.resolve_title(asked_names(spark, d), named_areas(spark, d))


_KEYS = "each AS (SELECT area_key, ord, unnest(['Street' || CAST(ord % 7 AS VARCHAR), 'Market' || CAST(ord AS VARCHAR)]) AS form FROM na), inside AS (SELECT form, arg_min(area_key, ord) AS area_key, min(ord) AS ord FROM each GROUP BY 1), idx AS (SELECT form, area_key FROM inside)"


@query("resolve_area_keyword", f"WITH {_NA}, {_KEYS}, {_STEPS} {_OUT}")
def _(spark, d):
    return names.resolve_keyword(asked_names(spark, d), named_areas(spark, d))


@query("gazetteer_build", f"{T.with_tables('stations')} SELECT 'S' || CAST(station_id % 40 AS VARCHAR) AS form, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, max(type) AS kind FROM stations GROUP BY 1")
def _(spark, d):
    rows = T.stations(spark, d).withColumn("name", F.concat(F.lit("S "), (F.col("station_id") % 40).cast("string")))
    return names.gazetteer(rows).select("form", _six(F.col("lat"), "lat"), _six(F.col("lon"), "lon"), "kind")


#: A place's name in the ways that people put it, each of which one step finds; no two places' words are alike.
_OWN_WORD = "'k' || substr(md5(CAST({} % 40 AS STRING)), 1, 10)"
_CALLED_WORD = _OWN_WORD.format("c_custkey")
_CALLED = f"""CASE c_custkey % 6 WHEN 0 THEN 'TowerSquare ' || {_CALLED_WORD} WHEN 1 THEN 'Old Mill ' || {_CALLED_WORD} WHEN 2 THEN 'Tower ' || {_CALLED_WORD}
WHEN 3 THEN 'near the ' || {_CALLED_WORD} WHEN 4 THEN 'see ' || {_CALLED_WORD} || ' now' ELSE 'nothing of the kind is here' END"""
_CALLED_STEPS = "CASE c_custkey % 6 WHEN 0 THEN 'whole' WHEN 1 THEN 'alias' WHEN 2 THEN 'bare' WHEN 3 THEN 'word' WHEN 4 THEN 'word' END"


@query("resolve_landmark", f"""{T.with_tables('stations')}, p AS (SELECT 'TowerSquare' || {_OWN_WORD.format('station_id').replace(*_V)} AS form, avg(lat) AS lat, avg(lon) AS lon FROM stations GROUP BY 1)
SELECT DISTINCT name, form, step, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (SELECT {_CALLED.replace(*_V)} AS name, {_CALLED_STEPS} AS step, 'TowerSquare' || {_CALLED_WORD.replace(*_V)} AS form FROM customer) JOIN p USING (form) WHERE step IS NOT NULL""")
def _(spark, d):
    """Names that mean a place by its name, an alias, without generic words, or by a word of its own. Slips of the pen are fuzzy_name's."""
    word = F.expr(_OWN_WORD.format("station_id"))
    named = T.stations(spark, d).withColumn("name", F.concat(F.lit("Tower Square "), word))
    mills = named.select("name", "lat", "lon", F.array(F.concat(F.lit("Old Mill "), word)).alias("aliases"))
    asked = T.table(spark, d, "customer").selectExpr(f"{_CALLED} AS name")
    found = names.resolve_landmark(asked, names.gazetteer(named, mills), generic=("Square", "near", "the"))
    return found.select("name", "form", "step", _six(F.col("lat"), "lat"), _six(F.col("lon"), "lon"))


_NEAR = """seg AS (SELECT s.station_id AS id, e.area_key, (x1 - s.lon) * k AS ax, (y1 - s.lat) * 111320E0 AS ay, (x2 - s.lon) * k AS bx, (y2 - s.lat) * 111320E0 AS by_, (y1 > s.lat) <> (y2 > s.lat) AND s.lon < (x2 - x1) * (s.lat - y1) / nullif(y2 - y1, 0) + x1 AS crossed FROM (SELECT *, cos(radians(lat)) * 111320E0 AS k FROM stations) s, edges e),
seg2 AS (SELECT *, greatest(0E0, least(1E0, -(ax * (bx - ax) + ay * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM seg), near AS (SELECT id, area_key, CASE WHEN sum(crossed::INT) % 2 = 1 THEN 0E0 ELSE min(sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2))) END AS meters FROM seg2 GROUP BY ALL)"""


@query("fuzzy_name", "WITH p AS (SELECT 'T' || substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 14) AS form FROM supplier) SELECT q.name, arg_min(form, levenshtein(q.name, form)) AS form FROM (SELECT 'x' || substr(form, 2) AS name FROM p) q, p WHERE levenshtein(q.name, form) <= 2 GROUP BY 1")
def _(spark, d):
    """Names with a letter wrong, of which SQL finds the place by edits."""
    own = T.table(spark, d, "supplier").select(F.concat(F.lit("T"), F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 14)).alias("form"))
    slips = own.select(F.concat(F.lit("x"), F.substring("form", 2, 20)).alias("name")).withColumn("__needle", F.col("name"))
    return names.fuzzy(slips, own, "name").select("name", F.col("__like").alias("form"))


_REQUESTS = "CAST(floor(c_custkey / 5) AS BIGINT) AS request, c_custkey AS pos, CASE c_custkey % 7 WHEN 0 THEN 'a' || CAST(c_custkey % 25 AS STRING) WHEN 1 THEN 'Place' || CAST(c_custkey % 25 AS STRING) || 'ville' WHEN 2 THEN 'Stop' || repeat(chr(CAST(65 + c_custkey % 10 AS INT)), 6) WHEN 3 THEN 'near Stop' || repeat(chr(CAST(65 + c_custkey % 10 AS INT)), 6) WHEN 4 THEN 'at Market' || CAST(c_custkey % 30 AS STRING) WHEN 5 THEN 'Street' || CAST(c_custkey % 9 AS STRING) ELSE 'nowhere' END AS name"
_TITLE_IDX = "t AS (SELECT area_key, ord, size, replace(title, ' ', '') AS form, replace(regexp_replace(title, '\\s*\\([^)]*\\)\\s*$', ''), ' ', '') AS bare FROM na), inside AS (SELECT form, arg_max(area_key, ord) AS area_key, max(ord) AS ord FROM t GROUP BY 1), idx AS (SELECT form, area_key FROM inside UNION ALL SELECT bare, arg_max(area_key, size) FROM t WHERE bare NOT IN (SELECT form FROM inside) GROUP BY 1)"


@query("resolve_area", f"""{T.with_tables('stations', 'area_base', 'areas', 'edges')}, {_NA.split(', asked AS')[0]}, r AS (SELECT {_REQUESTS.replace(*_V)} FROM customer), asked AS (SELECT DISTINCT name FROM r WHERE name NOT IN (SELECT area_key FROM na)),
title AS (SELECT name, area_key FROM (WITH {_TITLE_IDX}, {_STEPS} {_OUT})), stop AS (SELECT 'Stop' || repeat(chr(CAST(65 + station_id % 10 AS INT)), 6) AS form, avg(lat) AS lat, avg(lon) AS lon FROM stations GROUP BY 1),
mark AS (SELECT name AS station_id, lat, lon FROM asked JOIN stop ON list_contains(string_split(name, ' '), form) WHERE name NOT IN (SELECT name FROM title)),
around AS (SELECT id AS name, area_key, rank FROM (WITH stations AS (SELECT * FROM mark), {_NEAR} SELECT id, area_key, row_number() OVER (PARTITION BY id ORDER BY meters, area_key) AS rank FROM near JOIN areas USING (area_key) WHERE meters <= 700 QUALIFY rank <= 4)),
word AS (SELECT name, area_key FROM (WITH {_KEYS}, {_STEPS} {_OUT})),
every AS (SELECT area_key AS name, 1 AS rank, area_key FROM na UNION ALL SELECT name, 1, area_key FROM title UNION ALL SELECT name, rank, area_key FROM around UNION ALL SELECT name, 1, area_key FROM word WHERE name NOT IN (SELECT name FROM title UNION SELECT name FROM around)),
f1 AS (SELECT request, area_key, min(pos * 10 + rank) AS first FROM r JOIN every USING (name) GROUP BY 1, 2) SELECT q.request, coalesce(string_agg(area_key, ',' ORDER BY first), '') AS area_keys FROM (SELECT DISTINCT request FROM r) q LEFT JOIN f1 ON f1.request = q.request GROUP BY 1""")
def _(spark, d):
    """Lists of names: titles, stops, streets, keys."""
    asked = T.table(spark, d, "customer").selectExpr(*[f"{x}" for x in ("CAST(floor(c_custkey / 5) AS BIGINT) AS request", "c_custkey AS pos", _REQUESTS[_REQUESTS.index("CASE"):])])
    stops = T.stations(spark, d).withColumn("name", F.concat(F.lit("Stop"), F.expr("repeat(chr(65 + station_id % 10), 6)")))
    found = names.resolve_areas(asked, named_areas(spark, d), names.gazetteer(stops), T.areas(spark, d))
    return names.resolve_lists(asked, found).select("request", F.array_join("area_keys", ",").alias("area_keys"))


_CLAIM = "substr(md5(CAST(CASE WHEN c_custkey % 11 = 0 THEN c_custkey + 1 ELSE c_custkey END AS STRING)), 1, 12)"
_TITLED = f"CASE c_custkey % 5 WHEN 0 THEN {_CLAIM} WHEN 1 THEN {_CLAIM} || ' (x)' WHEN 2 THEN 'محله ' || {_CLAIM} || ' no' WHEN 3 THEN 'q' || substr({_CLAIM}, 2) ELSE 'elsewhere' END AS title, CASE WHEN c_custkey % 5 = 4 THEN 'by ' || {_CLAIM} END AS subtitle"


@query("name_list_match", f"""WITH n AS (SELECT c_custkey AS ord, substr(md5(CAST(c_custkey AS VARCHAR)), 1, 12) AS form FROM customer), i AS (SELECT id, replace(replace(title, ' (x)', ''), 'محله ', '') AS t, subtitle AS s FROM (SELECT c_custkey AS id, {_TITLED.replace(*_V)} FROM customer)),
x AS (SELECT id, t, s, e.form AS exact FROM i LEFT JOIN n e ON e.form = t), p AS (SELECT id, arg_min(form, ord) AS part FROM x JOIN n ON contains(t, form) OR contains(form, t) WHERE exact IS NULL GROUP BY 1), l AS (SELECT id, arg_min(form, levenshtein(t, form)) AS alike FROM x JOIN n ON levenshtein(t, form) <= 2 WHERE exact IS NULL GROUP BY 1), u AS (SELECT id, arg_min(form, ord) AS sub FROM x JOIN n ON contains(s, form) GROUP BY 1),
c AS (SELECT id, coalesce(exact, part, alike, sub) AS form, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN part IS NOT NULL THEN 'part' WHEN alike IS NOT NULL THEN 'like' WHEN sub IS NOT NULL THEN 'subtitle' END AS step FROM x LEFT JOIN p USING (id) LEFT JOIN l USING (id) LEFT JOIN u USING (id)),
w AS (SELECT *, form IS NOT NULL AND (count(*) OVER (PARTITION BY form) = 1 OR step = 'exact' AND count(*) FILTER (step = 'exact') OVER (PARTITION BY form) = 1) AS wins FROM c) SELECT id, CASE WHEN wins THEN form END AS polygon, CASE WHEN wins THEN step END AS step FROM w""")
def _(spark, d):
    """Each customer claims a polygon, some of them their neighbour's: by name, around it, with a slip or in the subtitle. SQL finds slips by edits."""
    customers = T.table(spark, d, "customer")
    polygons = customers.select(F.col("c_custkey").alias("ord"), F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 12).alias("name"))
    title, subtitle = _TITLED.split(" AS title, ")
    return names.match_name_list(customers.selectExpr("c_custkey AS id", f"{title} AS title", subtitle), polygons)


_SQUARE = 0.0003


@query("same_name_merge", f"{T.with_tables('stations')}, p AS (SELECT station_id AS id, 'S' || CAST(floor(station_id / 10) AS INT) AS name, lat, lon FROM stations), near AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.name = b.name AND a.id <> b.id AND sqrt(pow(greatest(abs(a.lat - b.lat) - {2 * _SQUARE}E0, 0) * 111320E0, 2) + pow(greatest(abs(a.lon - b.lon) - {2 * _SQUARE}E0, 0) * 111320E0 * cos(radians(a.lat)), 2)) <= 60) SELECT id, name, least(id, coalesce(min(b), id)) AS place FROM p LEFT JOIN near ON a = id GROUP BY id, name")
def _(spark, d):
    """Squares around the stations, named by tens; no chain of them is longer than two."""
    corners = ", ".join(f"named_struct('lat', lat + {a * _SQUARE}, 'lon', lon + {b * _SQUARE})" for a, b in ((-1, -1), (-1, 1), (1, 1), (1, -1)))
    bounds = [f"{x} {s} {_SQUARE} AS {m}_{x}" for x in ("lat", "lon") for m, s in (("min", "-"), ("max", "+"))]
    squares = T.stations(spark, d).selectExpr("station_id AS id", "'S' || CAST(CAST(floor(station_id / 10) AS INT) AS STRING) AS name", *bounds, f"array({corners}) AS ring")
    return spatial.same_name_places(squares)


@query("hash_embedding", f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS word FROM documents), c AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 2) AS INT) % {C.EMBEDDING_BUCKETS} AS bucket, count(*) AS n FROM w GROUP BY 1, 2) SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 9) AS weight FROM c")
def _(spark, d):
    made = names.hash_embedding(T.table(spark, d, "documents"), "doc_id", "text", C.EMBEDDING_BUCKETS)
    return made.select("doc_id", F.explode("vector").alias("bucket", "weight")).withColumn("weight", F.round("weight", 9))


_SELECTOR = "CASE c_custkey % 5 WHEN 0 THEN 'n' || CAST(c_custkey % 30 AS STRING) WHEN 1 THEN ' x' || CAST(c_custkey % 30 AS STRING) WHEN 2 THEN 'NATION_' || CAST(c_custkey % 30 AS STRING) WHEN 3 THEN 'TION_' || CAST(c_custkey % 30 AS STRING) ELSE ' ' END"


@query("shard_resolve", f"WITH k AS (SELECT n_nationkey AS shard, unnest(['n' || n_nationkey, 'x' || n_nationkey, n_name]) AS selector FROM nation), s AS (SELECT DISTINCT trim({_SELECTOR.replace(*_V)}) AS selector FROM customer), own AS (SELECT selector, min(shard) AS own FROM k GROUP BY 1), p AS (SELECT selector, arg_min(n_nationkey, length(n_name) * 1000 + n_nationkey) AS part FROM s JOIN nation ON contains(n_name, selector) GROUP BY 1) SELECT selector, coalesce(own, part) AS shard FROM s LEFT JOIN own USING (selector) LEFT JOIN p USING (selector) WHERE selector <> ''")
def _(spark, d):
    shards = T.table(spark, d, "nation").selectExpr("n_nationkey AS shard", "'n' || CAST(n_nationkey AS STRING) AS slug", "'x' || CAST(n_nationkey AS STRING) AS second_slug", "n_name AS name")
    return names.resolve_shards(T.table(spark, d, "customer").selectExpr(f"{_SELECTOR} AS selector"), shards)


@query("areas_by_key", f"{T.with_tables('area_base', 'areas')}, r AS (SELECT c_mktsegment AS request, c_custkey AS pos, 'a' || CAST(c_custkey * 7 % 30 AS VARCHAR) AS area_key FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) <= 60) SELECT request, pos, area_key, title FROM r JOIN areas USING (area_key)")
def _(spark, d):
    """Each segment's customers ask for areas, up to the limit of a request; unknown keys are dropped, the order is kept by pos."""
    asked = T.table(spark, d, "customer").selectExpr("c_mktsegment AS request", "c_custkey AS pos", "'a' || CAST(c_custkey * 7 % 30 AS STRING) AS area_key")
    return spatial.areas_by_key(asked, T.areas(spark, d)).select("request", "pos", "area_key", "title")


@query("src_areas", "SELECT 'a' || CAST(n_nationkey AS VARCHAR) AS area_key, n_nationkey AS ord, n_name AS title, 'k' || CAST(n_nationkey % 4 AS VARCHAR) || '|deux' AS keywords, 4 AS corners FROM nation")
def _(spark, d):
    """Two collections of features as JSON; keys of the first win."""

    def collection(title: str, order: int):
        ring = "array(array(0.0E0 + n_nationkey, 0.0E0), array(1.0E0 + n_nationkey, 0.0E0), array(1.0E0 + n_nationkey, 1.0E0), array(0.0E0 + n_nationkey, 1.0E0))"
        feature = f"named_struct('properties', named_struct('key', 'a' || CAST(n_nationkey AS STRING), 'ord', n_nationkey, 'title', {title}, 'keywords', 'k' || CAST(n_nationkey % 4 AS STRING) || '، deux'), 'geometry', named_struct('coordinates', array({ring})))"
        return T.table(spark, d, "nation").filter(f"n_nationkey % 3 <> {order}" if order == 0 else "true").groupBy(F.col("n_regionkey")).agg(F.to_json(F.struct(F.collect_list(F.expr(feature)).alias("features"))).alias("raw")).select(F.lit(order).alias("file"), "raw")

    files = kept(spark, d, "area-files", lambda: collection("n_name", 0).unionByName(collection("n_name || CASE WHEN n_nationkey % 3 <> 0 THEN '?' ELSE '' END", 1)))
    rows = spatial.read_areas(files)
    return rows.select("area_key", "ord", "title", F.array_join("keywords", "|").alias("keywords"), F.size("ring").alias("corners"))


@query("src_layers", "SELECT layer, key FROM (SELECT 'district' AS layer, 'd' || CAST(r_regionkey AS VARCHAR) AS key FROM region UNION ALL SELECT 'city', 'd' || CAST(max(r_regionkey) AS VARCHAR) FROM region)")
def _(spark, d):
    """Districts, and of them the largest as the city: each reaches further east than the one before."""
    rows = T.table(spark, d, "region").selectExpr("'d' || CAST(r_regionkey AS STRING) AS key", "array(named_struct('lat', 35.5E0, 'lon', 51.0E0), named_struct('lat', 35.5E0, 'lon', 51.1E0 + r_regionkey / 10), named_struct('lat', 35.6E0, 'lon', 51.1E0 + r_regionkey / 10), named_struct('lat', 35.6E0, 'lon', 51.0E0)) AS ring")
    return rows.select(F.lit("district").alias("layer"), "key").unionByName(spatial.largest(rows).select(F.lit("city").alias("layer"), "key"))




@query("areas_near", f"{T.with_tables('stations', 'area_base', 'areas', 'edges')}, {_NEAR} SELECT id, area_key, round(meters, 4) AS meters, row_number() OVER (PARTITION BY id ORDER BY meters, area_key) AS rank FROM near JOIN areas USING (area_key) WHERE meters <= 700 QUALIFY rank <= 4")
def _(spark, d):
    points = T.stations(spark, d).select(F.col("station_id").alias("id"), "lat", "lon")
    return spatial.areas_near(points, T.areas(spark, d)).withColumn("meters", F.round("meters", 4))


# Rasters of a hundredth of a degree over the city.
ROWS, COLUMNS, STEP = (3555, 3584), (5110, 5159), 0.01
_COVER = f"g AS (SELECT r AS row, c AS col, (r + 0.5E0) * 0.01E0 AS lat, (c + 0.5E0) * 0.01E0 AS lon FROM generate_series({ROWS[0]}, {ROWS[1]}) a(r), generate_series({COLUMNS[0]}, {COLUMNS[1]}) b(c)), cov AS (SELECT row, col, area_key FROM g, edges e GROUP BY ALL HAVING sum(CASE WHEN (e.y1 > g.lat) <> (e.y2 > g.lat) AND g.lon < (e.x2 - e.x1) * (g.lat - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1 THEN 1 ELSE 0 END) % 2 = 1)".replace("GROUP BY ALL", "GROUP BY row, col, area_key")
_CELLS = T.with_tables("area_base", "areas", "edges").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _COVER
_PARTS = "lk AS (SELECT p.id AS a, q.id AS b FROM n p JOIN n q ON abs(p.row - q.row) <= 1 AND abs(p.col - q.col) <= 1), walk AS (SELECT id, id AS part FROM n UNION SELECT b, part FROM walk JOIN lk ON a = walk.id), parts AS (SELECT id, min(part) AS part FROM walk GROUP BY 1)"


def city_cells(spark) -> DataFrame:
    rows = spark.range(ROWS[0], ROWS[1] + 1).withColumnRenamed("id", "row")
    return rows.withColumn("col", F.explode(F.sequence(F.lit(COLUMNS[0]).cast("bigint"), F.lit(COLUMNS[1]).cast("bigint"))))


@query("coverage_pct", f"{_CELLS} SELECT round(100E0 * count(DISTINCT CASE WHEN ord < 20 THEN row * 100000 + col END) / 1500, 6) AS before, round(100E0 * count(DISTINCT row * 100000 + col) / 1500, 6) AS after FROM cov JOIN areas USING (area_key)")
def _(spark, d):
    """Share of the city's cells inside an area: of the first areas alone, and with those that fill gaps."""
    found = spatial.covered_cells(T.areas(spark, d), STEP).join(T.areas(spark, d).select("area_key", "ord"), "area_key")
    per = city_cells(spark).join(found.groupBy("row", "col").agg(F.min("ord").alias("ord")), ["row", "col"], "left")
    share = lambda cond: F.round(100 * F.count_if(cond) / F.count(F.lit(1)), 6)
    return per.agg(share(F.coalesce(F.col("ord") < 20, F.lit(False))).alias("before"), share(F.col("ord").isNotNull()).alias("after"))


@query("uncovered_cells", f"{_CELLS}, n AS (SELECT row, col, row * 1048576 + col AS id FROM g WHERE (row, col) NOT IN (SELECT (row, col) FROM cov WHERE area_key NOT IN ('a7', 'a12'))), {_PARTS} SELECT row, col, part FROM n JOIN parts USING (id) WHERE part IN (SELECT part FROM parts GROUP BY 1 HAVING count(*) * 1.0064E0 >= 0.15E0)")
def _(spark, d):
    """Gaps between areas, two of which are left out; a cell is about a square kilometre, so none is too small or thin."""
    have = spatial.covered_cells(T.areas(spark, d).filter(~F.col("area_key").isin("a7", "a12")), STEP).select("row", "col").distinct()
    parts = spatial.with_part(city_cells(spark).join(have, ["row", "col"], "left_anti"))
    sqkm = STEP * STEP * (C.METERS_PER_DEGREE / 1000) ** 2 * 0.8121
    large = parts.groupBy("part").agg((F.count(F.lit(1)) * sqkm).alias("sqkm")).filter(F.col("sqkm") >= C.LEAST_GAP_SQKM)
    return parts.join(large.select("part"), "part", "left_semi").select("row", "col", "part")


@query("dissolve_cells", f"{_CELLS}, own AS (SELECT DISTINCT row, col FROM cov WHERE area_key IN ('a6', 'a7', 'a12', 'a24')), off AS (SELECT x, y FROM (VALUES (-1), (0), (1)) a(x), (VALUES (-1), (0), (1)) b(y)), wide AS (SELECT DISTINCT row + x AS row, col + y AS col FROM own, off), n AS (SELECT w.row, w.col, w.row * 1048576 + w.col AS id FROM wide w, off JOIN wide v ON v.row = w.row + x AND v.col = w.col + y GROUP BY w.row, w.col HAVING count(*) = 9), {_PARTS} SELECT row, col, part FROM n JOIN parts USING (id)")
def _(spark, d):
    """Chosen areas as one outline of cells, seams of a cell closed."""
    chosen = spatial.covered_cells(T.areas(spark, d).filter(F.col("area_key").isin("a6", "a7", "a12", "a24")), STEP)
    return spatial.with_part(spatial.closed(chosen)).select("row", "col", "part")


# Searches of customers: what a model read, and what their panel says.
_LEVELS = {"budget": "CASE c_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'normal' ELSE 'odd' END", "metro": "CASE c_custkey % 3 WHEN 0 THEN 'high' ELSE 'low' END"}
_STEP_SQL = "CASE {} WHEN 'low' THEN 0.4E0 WHEN 'high' THEN 2.2E0 ELSE 1E0 END"


@query("weights_from_importance", f"SELECT c_custkey AS search_id, {', '.join(f'round({w}E0 * ' + (_STEP_SQL.format(_LEVELS[k]) if k in _LEVELS else '1E0') + f', 9) AS w_{k}' for k, w in C.WEIGHTS.items())} FROM customer")
def _(spark, d):
    rows = T.table(spark, d, "customer").select(F.col("c_custkey").alias("search_id"), F.create_map(*[x for k, s in _LEVELS.items() for x in (F.lit(k), F.expr(s))]).alias("levels")).withColumn("w", search.weights_from_importance("levels"))
    return rows.select("search_id", *[F.round(F.col("w")[i], 9).alias(f"w_{k}") for i, k in enumerate(C.WEIGHTS)])


_EXTRACTED = "c_custkey AS search_id, 'Supplier#' || lpad(CAST(c_custkey % 120 AS STRING), 9, '0') AS workplace_name, CASE c_custkey % 5 WHEN 0 THEN 35.7E0 WHEN 1 THEN 99.0E0 END AS workplace_lat, CASE WHEN c_custkey % 5 < 2 THEN 51.4E0 END AS workplace_lon, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 11) / 10.0E0 END AS commute_importance, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 90 END AS max_commute, CASE WHEN c_custkey % 3 = 1 THEN 'prefer_higher_rent' END AS persona, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 50 * 10000000 END AS max_deposit, c_custkey % 6 = 0 AS wants_parking, 'standard' AS living_kind"
_CLEANED = f"{T.with_tables('stations')}, x AS (SELECT {_EXTRACTED.replace(*_V)} FROM customer), y AS (SELECT x.*, CASE WHEN workplace_lat IS NULL OR workplace_lon IS NULL THEN coalesce(lat, workplace_lat) ELSE workplace_lat END AS la, CASE WHEN workplace_lat IS NULL OR workplace_lon IS NULL THEN coalesce(lon, workplace_lon) ELSE workplace_lon END AS lo FROM x LEFT JOIN stations ON name = workplace_name), cleaned AS (SELECT search_id, workplace_name, CASE WHEN la BETWEEN 35.55E0 AND 35.85E0 AND lo BETWEEN 51.1E0 AND 51.6E0 THEN la END AS workplace_lat, CASE WHEN la BETWEEN 35.55E0 AND 35.85E0 AND lo BETWEEN 51.1E0 AND 51.6E0 THEN lo END AS workplace_lon, coalesce(commute_importance, 0.5E0) AS commute_importance, coalesce(max_commute, 45) AS max_commute, coalesce(persona, 'balanced') AS persona, max_deposit, wants_parking, living_kind FROM y)"


def _cleaned(spark, d) -> DataFrame:
    import re

    extracted = T.table(spark, d, "customer").selectExpr(*re.split(r", (?='Supplier|CASE|c_custkey % 6|'standard)", _EXTRACTED))
    return search.clean(extracted, T.stations(spark, d).select("name", "lat", "lon"), {c: default for c, (_, default) in T.INTENT.items()})


@query("intent_clean", f"{_CLEANED} SELECT search_id, round(workplace_lat, 6) AS workplace_lat, round(workplace_lon, 6) AS workplace_lon, commute_importance, max_commute, persona FROM cleaned")
def _(spark, d):
    return _cleaned(spark, d).select("search_id", _six(F.col("workplace_lat"), "workplace_lat"), _six(F.col("workplace_lon"), "workplace_lon"), "commute_importance", "max_commute", "persona")


@query("intent_assemble", f"{_CLEANED}, {_NA} SELECT search_id, CASE WHEN search_id % 2 = 0 THEN search_id * 1000 ELSE max_deposit END AS max_deposit, wants_parking OR search_id % 4 = 0 AS wants_parking, CASE WHEN search_id % 9 = 0 THEN 'shared' ELSE 'standard' END AS living_kind, array_to_string(list_filter([k1, CASE WHEN k2 IS DISTINCT FROM k1 THEN k2 END], lambda k: k IS NOT NULL), ',') AS area_keys FROM (SELECT c.*, a.area_key AS k1, b.area_key AS k2 FROM cleaned c LEFT JOIN na a ON a.title = 'Place' || CAST(search_id % 30 AS VARCHAR) || 'ville' LEFT JOIN na b ON b.title = 'Place' || CAST(search_id * 3 % 30 AS VARCHAR) || 'ville')")
def _(spark, d):
    place = lambda x: F.concat(F.lit("Place"), (x % 30).cast("string"), F.lit("ville"))
    own = F.col("search_id")
    panels = T.table(spark, d, "customer").select(F.col("c_custkey").alias("search_id")).select("search_id", F.when(own % 2 == 0, own * 1000).alias("max_deposit"), F.when(own % 4 == 0, True).alias("wants_parking"), F.when(own % 9 == 0, "shared").otherwise("standard").alias("living_kind"), F.array(place(own), place(own * 3)).alias("area_names"))
    intents = _cleaned(spark, d).withColumn("area_keys", F.array().cast("array<string>"))
    out = search.assemble(intents, panels, named_areas(spark, d).select(F.col("title").alias("name"), "area_key"))
    return out.select("search_id", "max_deposit", "wants_parking", "living_kind", F.array_join("area_keys", ",").alias("area_keys"))


# The same three at a scale at which streets show.
_CITY_SQM = "(0.3E0 * 0.5E0)"


@query("coverage_fine", f"{T.with_tables('area_base', 'areas', 'edges')}, a AS (SELECT area_key, any_value(ord) AS ord, abs(sum(x1 * y2 - x2 * y1)) / 2 AS size FROM areas JOIN edges USING (area_key) GROUP BY 1) SELECT round(100 * sum(CASE WHEN ord < 20 THEN size END) / {_CITY_SQM}, 1) AS before, round(100 * sum(size) / {_CITY_SQM}, 1) AS after FROM a")
def _(spark, d):
    """Share of the city inside an area, by cells of ten metres along the borders; SQL has the exact areas."""
    cells = raster.cover(T.areas(spark, d)).join(T.areas(spark, d).select("area_key", "ord"), "area_key")
    city = (C.CITY["max_lat"] - C.CITY["min_lat"]) * raster.LAT_M * (C.CITY["max_lon"] - C.CITY["min_lon"]) * raster.LON_M / 1e6
    share = [raster.united(rows).agg((100 * raster.square_km(rows) / city).alias(n)) for n, rows in (("before", cells.filter("ord < 20")), ("after", cells))]
    return share[0].crossJoin(share[1]).select(F.round("before", 1).alias("before"), F.round("after", 1).alias("after"))  # one row each


@query("dissolve_fine", f"{T.with_tables('area_base', 'areas', 'edges')}, a AS (SELECT area_key, abs(sum(x1 * y2 - x2 * y1)) / 2 * {raster.LAT_M!r} * {raster.LON_M!r} / 1e6 AS size FROM edges WHERE area_key IN ('a6', 'a7', 'a12', 'a24') GROUP BY 1) SELECT count(*) AS parts, round(sum(size), 0) AS sqkm FROM a")
def _(spark, d):
    """Chosen areas with seams of 25 metres closed: these lie further apart, so they stay as many parts."""
    cells = raster.united(raster.cover(T.areas(spark, d).filter(F.col("area_key").isin("a6", "a7", "a12", "a24")), 20.0, 6))
    parts = raster.with_part(raster.closed_seams(cells, C.SEAM_M, 20.0, 6), 6)
    return parts.agg(F.count_distinct("part").alias("parts"), F.round(raster.square_km(parts, 20.0), 0).alias("sqkm"))
