"""Queries over the whole corpus and its rankings: quality, quotas, text search, scorecard, trade-offs; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus, evaluation, market, quality, spatial, textsearch
from ..sources import tables as T
from ..sources.prepared import kept
from .catalog import _PARK, FLOORS, GEO_CTE, MARKET_CTE, REPOSTS, _placed, _reposts, query

# Districts: a rectangle for each region, with a prior price.
DISTRICT = "r_regionkey AS ord, 'd' || CAST(r_regionkey AS STRING) AS district, 60.0E6 + 35.0E6 * r_regionkey AS prior, 35.5500005E0 + 0.06E0 * r_regionkey AS min_lat, 35.6100005E0 + 0.06E0 * r_regionkey AS max_lat"
_DISTRICTS = f"districts AS (SELECT {DISTRICT} FROM region)".replace("AS STRING", "AS VARCHAR")


def districts(spark, d):
    rows = T.table(spark, d, "region").selectExpr(*DISTRICT.split(", ")).withColumn("min_lon", F.lit(51.1)).withColumn("max_lon", F.lit(51.6))
    corner = lambda lat, lon: F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    return rows.withColumn("area_key", F.col("district")).withColumn("ring", F.array(corner("min_lat", "min_lon"), corner("min_lat", "max_lon"), corner("max_lat", "max_lon"), corner("max_lat", "min_lon")))


def areas_in_districts(spark, d):
    centers = T.areas(spark, d).selectExpr("area_key AS id", "center_lat AS lat", "center_lon AS lon")
    inside = spatial.first_polygon(centers, districts(spark, d)).select(F.col("id").alias("area_key"), F.col("area_key").alias("district"))
    return inside.join(districts(spark, d).select("district", "prior"), "district", "left").select("area_key", "district", "prior")


@query("district_of", f"{T.with_tables('listings')}, {_DISTRICTS} SELECT id, district FROM listings LEFT JOIN districts ON lat > min_lat AND lat < max_lat")
def _(spark, d):
    return spatial.first_polygon(T.listings(spark, d), districts(spark, d)).withColumnRenamed("area_key", "district")


@query("areas_list", f"{T.with_tables('area_base', 'areas')} SELECT area_key, title, round(center_lat, 6) AS center_lat, round(center_lon, 6) AS center_lon FROM areas")
def _(spark, d):
    return T.areas(spark, d).select("area_key", "title", F.round("center_lat", 6).alias("center_lat"), F.round("center_lon", 6).alias("center_lon"))


@query("area_at_point", f"{GEO_CTE.replace('FROM listings l JOIN areas', 'FROM (SELECT station_id AS id, lat, lon FROM stations) l JOIN areas').replace('WITH ', 'WITH ' + T.with_tables('stations')[5:] + ', ', 1)} SELECT station_id AS id, area_key FROM stations LEFT JOIN located ON id = station_id")
def _(spark, d):
    return spatial.first_polygon(T.stations(spark, d).select(F.col("station_id").alias("id"), "lat", "lon"), T.areas(spark, d))


@query("nearest_anchor", f"{T.with_tables('listings', 'area_base', 'areas')} SELECT id, arg_min(area_key, sqrt(pow(lat - center_lat, 2) + pow(lon - center_lon, 2))) AS area_key FROM listings, areas GROUP BY id")
def _(spark, d):
    return spatial.nearest_anchor(T.listings(spark, d), T.areas(spark, d))


_RANK = "CASE WHEN {c} IS NOT NULL THEN CASE WHEN count({c}) OVER () = 1 THEN 0.5E0 ELSE (rank() OVER (ORDER BY {c} NULLS LAST) - 1 + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / (count({c}) OVER () - 1) END END"
INDEX = f"""{_DISTRICTS}, ad AS (SELECT area_key, district, prior FROM areas LEFT JOIN districts ON center_lat > districts.min_lat AND center_lat < districts.max_lat),
loc AS (SELECT area_key, median((rent + deposit * 0.03E0) / area_sqm) AS loc, count(*) AS n, median(build_year) AS year FROM placed WHERE area_key IS NOT NULL GROUP BY 1),
j AS (SELECT area_key, district, prior, loc, coalesce(n, 0) AS n, year FROM ad LEFT JOIN loc USING (area_key)),
k AS (SELECT *, prior * coalesce((SELECT avg(loc) / avg(prior) FROM j WHERE n >= 5 AND prior IS NOT NULL), 1E0) AS drawn FROM j),
c AS (SELECT *, coalesce((n * loc + 8 * drawn) / (n + 8), loc, drawn) AS cost FROM k), q AS (SELECT *, {_RANK.format(c='cost')} AS prestige, {_RANK.format(c='year')} AS own FROM c),
m AS (SELECT *, coalesce(own, median(own) OVER (PARTITION BY district), 0.5E0) AS modernity FROM q), qi AS (SELECT area_key, 0.72E0 * prestige + 0.28E0 * modernity AS score, prestige, modernity, n FROM m WHERE cost IS NOT NULL)"""


@query("quality_index", f"{MARKET_CTE}, {INDEX} SELECT area_key, round(score, 4) AS score, round(prestige, 4) AS prestige, round(modernity, 4) AS modernity, n FROM qi")
def _(spark, d):
    return quality.quality_index(_placed(spark, d), areas_in_districts(spark, d)).select("area_key", *[F.round(c, 4).alias(c) for c in ("score", "prestige", "modernity")], "n")


@query("quality_lookup", f"{MARKET_CTE}, {INDEX} SELECT id, round(coalesce(score, 0.5E0), 4) AS quality FROM placed LEFT JOIN qi USING (area_key)")
def _(spark, d):
    rows = _placed(spark, d)
    return quality.quality_lookup(rows, quality.quality_index(rows, areas_in_districts(spark, d))).select("id", F.round("quality", 4).alias("quality"))


def _rates(spark, d):
    return T.table(spark, d, "events").groupBy(F.col("user_id").alias("shard")).agg(F.count(F.lit(1)).cast("double").alias("rate"), F.max("ts").alias("measured"))


@query("rate_freshness", "WITH r AS (SELECT user_id AS shard, max(ts) AS measured FROM events GROUP BY 1) SELECT shard FROM r WHERE measured >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY")
def _(spark, d):
    last = T.table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp")).cast("string").alias("t")).first()["t"]
    return quality.fresh_rates(_rates(spark, d), last).select("shard")


_PASSES = """rates AS (SELECT user_id AS shard, count(*) * 1E0 AS rate FROM events GROUP BY 1), known AS (SELECT * FROM rates WHERE shard % 5 <> 0), mid AS (SELECT rate AS m FROM known ORDER BY rate LIMIT 1 OFFSET (SELECT count(*) // 2 FROM known)),
q0 AS (SELECT r.shard, pow(greatest(coalesce(k.rate, m), 1e-6), 0.75E0) AS weight, CAST(NULL AS BIGINT) AS quota, true AS open, true AS live, 3000E0 AS left_over FROM rates r LEFT JOIN known k USING (shard), mid)"""
for _i in range(6):
    _PASSES += f""", a{_i} AS (SELECT *, CASE WHEN live AND open THEN CAST(least(400, greatest(8, round_even(left_over * weight / sum(weight) FILTER (open) OVER (), 0))) AS BIGINT) ELSE quota END AS next FROM q{_i}),
b{_i} AS (SELECT *, greatest(0E0, 3000 - 400 * count(*) FILTER (next = 400) OVER ()) AS rest FROM a{_i}),
q{_i + 1} AS (SELECT shard, weight, next AS quota, CASE WHEN live AND rest <> left_over THEN coalesce(next < 400, true) ELSE open END AS open, live AND rest <> left_over AND rest > 0 AS live, CASE WHEN live THEN rest ELSE left_over END AS left_over FROM b{_i})"""


@query("allocate_quotas", f"WITH {_PASSES} SELECT shard, coalesce(quota, 8) AS quota FROM q6")
def _(spark, d):
    return quality.allocate_quotas(_rates(spark, d).select("shard"), _rates(spark, d).filter("shard % 5 <> 0").select("shard", "rate"), 3000)


@query("uniform_quota", "SELECT greatest(8, CAST(ceil(3000 / count(DISTINCT user_id)) AS BIGINT)) AS quota FROM events")
def _(spark, d):
    return quality.uniform_quota(_rates(spark, d), 3000)


# Each whole benchmark passage is a query over all texts: those with all its words.
_TERMS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r]+'), lambda x: x <> '')"


@query("text_search", f"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({_TERMS}) AS term FROM benchmark), w AS (SELECT query_id, count(*) AS wanted FROM q GROUP BY 1), s AS (SELECT doc_id AS id, {_TERMS} AS words FROM documents),
g AS (SELECT count(*) AS docs, avg(len(words)) AS mean FROM s), x AS (SELECT id, len(words) AS length, unnest(words) AS term FROM s), p AS (SELECT term, id, length, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
h AS (SELECT query_id, id, sum(ln(1 + (docs - df + 0.5E0) / (df + 0.5E0)) * tf * 2.2E0 / (tf + 1.2E0 * (0.25E0 + 0.75E0 * length / mean))) AS score, count(*) AS got FROM q JOIN p USING (term) JOIN f USING (term), g GROUP BY ALL)
SELECT query_id, id, round(score, 6) AS score FROM h JOIN w USING (query_id) WHERE got = wanted QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 500""")
def _(spark, d):
    asked = T.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    texts = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return textsearch.search(texts, asked).withColumn("score", F.round("score", 6))


# A scorecard in which a home's own fields were asked for and others came back.
_FIELDS = (
    ("rooms", "eq", "[CAST(rooms AS VARCHAR)]", "CASE WHEN ingest_seq % 29 <> 0 THEN [CAST((ingest_seq * 13 + ingest_seq % 3) % 5 AS VARCHAR)] END"),
    ("area", "range", "[CAST(area_sqm - 8 AS VARCHAR), CAST(area_sqm + 8 AS VARCHAR)]", "CASE WHEN ingest_seq % 29 <> 0 THEN [CAST(area_sqm + ingest_seq % 13 AS VARCHAR)] END"),
    ("floor", "forbid", "['0']", "CASE WHEN ingest_seq % 29 <> 0 THEN [CAST(greatest(floor, 0) AS VARCHAR)] END"),
    ("place", "contains", "[CAST(area_sqm % 10 AS VARCHAR)]", "CASE WHEN ingest_seq % 29 <> 0 THEN [CAST(rent AS VARCHAR), CAST(deposit AS VARCHAR)] END"),
)
_OK = {"eq": "actual = expected", "forbid": "actual = expected", "range": "CAST(actual[1] AS DOUBLE) BETWEEN CAST(expected[1] AS DOUBLE) AND CAST(expected[2] AS DOUBLE)", "contains": "(contains(actual[1], expected[1]) OR contains(actual[2], expected[1]))"}
_JUDGED = T.with_tables("listings") + ", judged AS (" + " UNION ALL ".join(f"SELECT \"case\", \"group\", '{f}' AS field, '{m}' AS mode, coalesce({_OK[m]}, false) AS correct FROM (SELECT id AS \"case\", ingest_seq % 7 AS \"group\", {e} AS expected, {a} AS actual FROM listings)" for f, m, e, a in _FIELDS) + ")"


def _judged(spark, d):
    array = lambda sql: sql.replace("[", "array(").replace("]", ")").replace("VARCHAR", "STRING")
    rows = T.listings(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(m).alias("mode"), F.expr(array(e)).alias("expected"), F.expr(array(a)).alias("actual")) for f, m, e, a in _FIELDS]))
    return evaluation.judge_fields(rows.select(F.col("id").alias("case"), (F.col("ingest_seq") % 7).alias("group"), each.alias("f")).select("case", "group", "f.*"))


@query("eval_fields", f"{_JUDGED} SELECT \"case\", field, mode, correct FROM judged")
def _(spark, d):
    return _judged(spark, d).select("case", "field", "mode", "correct")


@query("eval_invented", f"{_JUDGED} SELECT \"case\", field FROM judged WHERE mode = 'forbid' AND NOT correct")
def _(spark, d):
    return evaluation.invented(_judged(spark, d))


@query("eval_rollup", f"{_JUDGED}, per AS (SELECT \"case\", \"group\", count(*) FILTER (correct) AS good, count(*) AS fields FROM judged GROUP BY 1, 2), s AS (SELECT id AS \"case\", CASE WHEN ingest_seq % 4 <> 0 THEN ingest_seq % 5 END AS score FROM listings) SELECT \"group\", count(*) AS cases, count(*) FILTER (good = fields) AS clean, CAST(sum(good) AS BIGINT) AS correct, CAST(sum(fields) AS BIGINT) AS total, round(avg(score), 6) AS judge FROM per JOIN s USING (\"case\") GROUP BY GROUPING SETS ((\"group\"), ())")
def _(spark, d):
    scores = T.listings(spark, d).selectExpr("id AS case", "CASE WHEN ingest_seq % 4 <> 0 THEN ingest_seq % 5 END AS score")
    return evaluation.rollup(_judged(spark, d), scores).withColumn("judge", F.round("judge", 6))


# Corpus.


_MERGE = f"""{T.with_tables('listings')}, {REPOSTS}, stored AS (SELECT * FROM r WHERE ingest_seq < 100000000 AND ingest_seq % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ingest_seq) = 1),
batch AS (SELECT * FROM r WHERE ingest_seq >= 100000000 OR ingest_seq % 3 = 0 UNION ALL SELECT id, ingest_seq + 200000000, fingerprint || '!', rent FROM r WHERE ingest_seq % 15 = 0 AND ingest_seq < 100000000),
owner AS (SELECT fingerprint, arg_min(id, ingest_seq) AS owner FROM stored GROUP BY 1), n AS (SELECT b.*, o.owner, s.id IS NOT NULL AS known FROM batch b LEFT JOIN owner o USING (fingerprint) LEFT JOIN (SELECT DISTINCT id FROM stored) s USING (id)),
f AS (SELECT fingerprint, min(ingest_seq) AS seq, arg_min(id, ingest_seq) AS first FROM n WHERE owner IS NULL AND NOT known GROUP BY 1), t AS (SELECT n.* FROM n LEFT JOIN f USING (fingerprint) WHERE coalesce(owner, CASE WHEN seq < ingest_seq THEN first END, id) = id),
last AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq DESC) = 1),
merged AS (SELECT id, ingest_seq, fingerprint, rent, 'kept' AS action FROM stored WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT id, ingest_seq, fingerprint, rent, CASE WHEN known THEN 'updated' ELSE 'inserted' END FROM last)"""


def _stored_and_batch(spark, d):
    rows = _reposts(spark, d)
    changed = rows.filter("ingest_seq % 15 = 0 AND ingest_seq < 100000000").withColumn("ingest_seq", F.col("ingest_seq") + 200_000_000).withColumn("fingerprint", F.concat("fingerprint", F.lit("!")))
    return corpus.dedup_first(rows.filter("ingest_seq < 100000000 AND ingest_seq % 3 <> 0")), rows.filter("ingest_seq >= 100000000 OR ingest_seq % 3 = 0").unionByName(changed)


@query("upsert_merge", f"{_MERGE} SELECT * FROM merged")
def _(spark, d):
    return corpus.upsert(*_stored_and_batch(spark, d))


@query("upsert_counts", f"{_MERGE} SELECT count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'updated') AS updated, (SELECT count(DISTINCT id) FROM batch) - count(*) FILTER (action <> 'kept') AS skipped_duplicate, count(*) AS total FROM merged")
def _(spark, d):
    stored, batch = _stored_and_batch(spark, d)
    return corpus.upsert_counts(corpus.upsert(stored, batch), batch.dropDuplicates(["id"]))


@query("reclassify_backfill", f"{T.with_tables('adverts')} SELECT k, k % 10 = 0 OR {_PARK} AS is_shared FROM adverts")
def _(spark, d):
    """Stored rows flagged under an older revision: the rule that came later is run on those without the flag."""
    stored = T.adverts(spark, d).withColumn("is_shared", F.col("k") % 10 == 0)
    title, description = F.col("title"), F.col("description")
    rows, stamp = corpus.backfill(stored, "1", "2", "is_shared", text.is_not_a_home(title, description), text.is_parking_rental(title))
    return corpus.backfill(rows, stamp, "2", "is_shared", F.lit(True), F.lit(True))[0].select("k", "is_shared")


@query("sink_corpus_rebuild", f"{T.with_tables('listings')}, {REPOSTS} SELECT id, ingest_seq, rent FROM r QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ingest_seq) = 1")
def _(spark, d):
    return kept(spark, d, "corpus", lambda: corpus.dedup_first(_reposts(spark, d))).select("id", "ingest_seq", "rent")


@query("sink_price_floors", f"{T.with_tables('listings')}, {FLOORS} SELECT cell_row, cell_col, round(price_floor, 2) AS price_floor FROM floors")
def _(spark, d):
    """Floors to two places, written and read back."""
    return kept(spark, d, "price-floors", lambda: market.price_floors(T.listings(spark, d), 0.05).withColumn("price_floor", F.round("price_floor", 2))).select("cell_row", "cell_col", "price_floor")
