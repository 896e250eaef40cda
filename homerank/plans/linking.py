"""Queries that link and enrich adverts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keywords, names, spatial
from ..sources import tables as T
from .catalog import GEO_CTE, _placed, query

#: The name that an advert gives for its area, and whether it shows a point: some have no name, some a title that no point bears out, some
#: a name that only points outside all areas have.
_SEEN = "ingest_seq % 19 <> 0"
_NAME = """CASE WHEN ingest_seq % 6 = 0 THEN NULL WHEN ingest_seq % 38 = 0 THEN ' NATION_' || CAST(ingest_seq % 25 AS STRING) WHEN area_key IS NULL AND ingest_seq % 7 = 0 THEN 'out' || CAST(ingest_seq % 5 AS STRING)
ELSE 'n' || CAST(CAST(floor(lat * 20) AS BIGINT) AS STRING) || 'x' || CAST(CAST(floor(lon * 20) AS BIGINT) AS STRING) END"""
_HYPOT = "sqrt(pow(lat - center_lat, 2) + pow(lon - center_lon, 2))"
_ADV = f"adv AS (SELECT id, lat, lon, trim({_NAME.replace('STRING', 'VARCHAR')}) AS name, CASE WHEN {_SEEN} THEN area_key END AS area_key, {_SEEN} AS seen FROM listings LEFT JOIN located USING (id))"
_VOTES = f"""tally AS (SELECT name, area_key, count(*) AS votes FROM adv WHERE name IS NOT NULL AND area_key IS NOT NULL GROUP BY ALL), best AS (SELECT * FROM tally QUALIFY row_number() OVER (PARTITION BY name ORDER BY votes DESC, area_key) = 1),
own AS (SELECT DISTINCT name, areas.area_key FROM adv JOIN areas ON title = name), named AS (SELECT * FROM own WHERE name NOT IN (SELECT name FROM best)),
means AS (SELECT name, avg(lat) AS lat, avg(lon) AS lon FROM adv WHERE seen AND name IS NOT NULL AND name NOT IN (SELECT name FROM best UNION SELECT name FROM named) GROUP BY 1),
votes AS (SELECT name, area_key, votes, 'points' AS how FROM best UNION ALL SELECT name, area_key, 0, 'name' FROM named UNION ALL SELECT name, arg_min(area_key, {_HYPOT}), 0, 'mean_point' FROM means, areas GROUP BY name)"""


def _adverts(spark, d):
    rows = _placed(spark, d).selectExpr("id", "lat", "lon", f"trim({_NAME}) AS name", f"CASE WHEN {_SEEN} THEN area_key END AS area_key", f"{_SEEN} AS seen")
    return rows.withColumns({c: F.when(F.col("seen"), F.col(c)) for c in ("lat", "lon")})


def _resolved(spark, d, rows):
    """What the names mean by themselves."""
    titled = T.areas(spark, d).withColumn("size", F.lit(1))
    return names.resolve_title(rows.select("name").filter("name <> ''").distinct(), titled).select("name", "area_key", F.lit(1).alias("rank"))


def _voted(spark, d, rows):
    return names.name_vote(rows, _resolved(spark, d, rows), T.areas(spark, d))


@query("unique_tokens", "WITH w AS (SELECT DISTINCT s_suppkey AS id, unnest(string_split_regex(lower(s_name), '[ #]+')) AS token FROM supplier) SELECT token, min(id) AS id FROM w WHERE length(token) >= 3 GROUP BY token HAVING count(*) = 1")
def _(spark, d):
    return names.unique_tokens(T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("name_vote", f"{GEO_CTE}, {_ADV}, {_VOTES} SELECT * FROM votes")
def _(spark, d):
    return _voted(spark, d, _adverts(spark, d))


@query("alias_union", f"{GEO_CTE}, {_ADV}, {_VOTES}, every AS (SELECT area_key, name FROM votes JOIN areas USING (area_key) WHERE name <> title AND name <> 'out' || ord % 5 UNION SELECT area_key, upper(area_key) FROM areas) SELECT area_key, array_to_string(list_sort(list(name)), ',') AS aliases FROM every GROUP BY 1")
def _(spark, d):
    areas = T.areas(spark, d).withColumn("keywords", F.array(F.concat(F.lit("out "), (F.col("ord") % 5).cast("string"))))
    out = names.alias_union(_voted(spark, d, _adverts(spark, d)), areas, areas.select("area_key", F.upper("area_key").alias("name")))
    return out.select("area_key", F.array_join("aliases", ",").alias("aliases"))


@query("link_area", f"""{GEO_CTE}, {_ADV}, {_VOTES}, near AS (SELECT id, arg_min(areas.area_key, {_HYPOT}) AS near FROM adv, areas GROUP BY id),
l AS (SELECT adv.id, lat, lon, seen, CASE WHEN seen THEN coalesce(adv.area_key, votes.area_key, near) ELSE coalesce(votes.area_key, own.area_key) END AS area_key,
  CASE WHEN NOT seen THEN CASE WHEN coalesce(votes.area_key, own.area_key) IS NOT NULL THEN 'neighborhood_centroid' END WHEN adv.area_key IS NOT NULL THEN 'point_in_polygon' WHEN votes.area_key IS NOT NULL THEN 'name_vote' ELSE 'nearest_polygon' END AS link_method
  FROM adv LEFT JOIN votes USING (name) LEFT JOIN own USING (name) JOIN near ON near.id = adv.id)
SELECT id, area_key, round(CASE WHEN seen THEN lat ELSE center_lat END, 6) AS lat, round(CASE WHEN seen THEN lon ELSE center_lon END, 6) AS lon, link_method FROM l LEFT JOIN areas USING (area_key)""")
def _(spark, d):
    rows, areas = _adverts(spark, d), T.areas(spark, d)
    anchors = spatial.nearest_anchor(rows.filter("seen"), areas)
    out = names.link_area(rows.withColumnRenamed("area_key", "contained"), _voted(spark, d, rows), anchors, areas, _resolved(spark, d, rows))
    return out.withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


#: Things on the map: one for each listing, named and tagged by its number; words stand before some names, and some labels are no names.
_THING = "'نام ' || CAST(ingest_seq * 7 % 400 AS STRING)"
_LABEL = f"""CASE ingest_seq % 11 WHEN 0 THEN 'خیابان  ' || {_THING} WHEN 1 THEN 'بلوار شهید ' || {_THING} WHEN 2 THEN 'منطقه ' || CAST(ingest_seq % 22 AS STRING) WHEN 3 THEN 'Street ' || CAST(ingest_seq AS STRING) WHEN 4 THEN 'پارک ' || {_THING} WHEN 5 THEN 'پل ' WHEN 6 THEN NULL ELSE {_THING} END"""
_TAGS = "CASE ingest_seq * 3 % 8 WHEN 0 THEN map('place', 'suburb') WHEN 1 THEN map('railway', 'station') WHEN 2 THEN map('public_transport', 'station', 'x', 'y') WHEN 3 THEN map('amenity', 'cafe') ELSE map('highway', 'primary', 'place', '') END"
_UNTITLED = "CASE WHEN ord % 3 = 0 THEN NULL WHEN ord % 3 = 1 THEN 'کوهسار' ELSE 'آب-باد ' || CAST(ord AS STRING) END AS title, CASE WHEN ord % 4 <> 0 THEN 'd' || CAST(ord % 2 AS STRING) END AS district"


@query("poi_keywords", f"""{GEO_CTE}, f AS (SELECT area_key, ingest_seq AS pos, CASE ingest_seq * 3 % 8 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS kind,
  CASE WHEN ingest_seq % 11 IN (2, 3, 5, 6) THEN NULL WHEN ingest_seq % 11 = 4 THEN 'پارک ' || {_THING.replace('STRING', 'VARCHAR')} ELSE {_THING.replace('STRING', 'VARCHAR')} END AS name FROM listings JOIN located USING (id)),
g AS (SELECT area_key, kind, name, min(pos) AS pos FROM f WHERE name IS NOT NULL GROUP BY ALL), h AS (SELECT *, row_number() OVER (PARTITION BY area_key, kind ORDER BY pos) AS rank FROM g),
k AS (SELECT area_key, replace(name, ' ', '') AS form, arg_min(name, kind * 100 + rank) AS name, min(kind * 100 + rank) AS place FROM h WHERE rank <= CASE kind WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 3 END GROUP BY 1, 2),
l AS (SELECT area_key, arg_min(name, pos) AS label FROM g WHERE kind = 0 AND name NOT LIKE 'پارک%' GROUP BY 1),
t AS (SELECT area_key, coalesce(u.title, label) AS base, district FROM (SELECT area_key, {_UNTITLED.replace('STRING', 'VARCHAR')} FROM areas) u LEFT JOIN l USING (area_key) WHERE coalesce(u.title, label) IS NOT NULL),
s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY base) > 1 AND district IS NOT NULL THEN base || ' (' || district || ')' ELSE base END AS shown FROM t),
w AS (SELECT area_key, string_agg(k.name, '|' ORDER BY place) AS words FROM s JOIN k USING (area_key) WHERE form <> replace(base, ' ', '') GROUP BY 1)
SELECT area_key, shown AS title, concat_ws('|', CASE WHEN base LIKE 'آب-باد%' THEN replace(base, 'آب-', '') || '|آب' END, CASE WHEN shown <> base THEN base END, words) AS keywords FROM s LEFT JOIN w USING (area_key)""")  # fmt: skip
def _(spark, d):
    """Areas, a third of them without a title and another third of one name, by the things inside them."""
    things = _placed(spark, d).selectExpr("area_key", "ingest_seq AS pos", f"{_LABEL} AS name", f"{_TAGS} AS tags")
    out = keywords.poi_keywords(T.areas(spark, d).selectExpr("area_key", *_UNTITLED.replace("title, ", "title,, ").split(",, ")), things)
    return out.select("area_key", "title", F.array_join("keywords", "|").alias("keywords"))
