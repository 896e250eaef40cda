"""A table of searches against a table of listings: narrowing, utilities, score, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.geo import cell, haversine_km, in_box, manhattan_m
from ..functions.money import budget_ratio, resolve_split, tmc
from ..functions.text import digits_persian
from . import transit
from .iterate import cut

#: The terms of a score, in the order of an intent's own weights.
UTILITIES = ("budget", "value", "area", "amenity", "metro", "commute", "quality", "freshness", "soft")
# The parts of a trade-off sentence.
TRADE_WORDS = {
    "this": "این مورد ", "larger": " متر بزرگ‌تر است", "in_budget": "در بودجهٔ شما می‌گنجد", "near_metro": "دسترسی مشابه یا بهتری به مترو دارد",
    "but": "، اما ", "over_budget": "٪ بالاتر از بودجهٔ شماست", "longer_walk": " دقیقه پیاده‌روی بیشتری تا مترو دارد", "and": " و ",
}
#: Up to so many searches are sent to every task; more are dealt with the listings by size.
FEW_INTENTS = 2_000
#: Blocks into which a large set of queries is dealt; every row goes to each.
QUERY_BLOCKS = 64
#: Width in square metres of the bins by which many searches meet listings, and the last bin.
BIN_SQM, LAST_BIN = 20, 100
#: Bins of score by which a search's whole ranking is dealt.
RANK_BINS = 1 << 14


def weights(intents: DataFrame, has_quality: bool = True) -> DataFrame:
    """Searches with a normalised weight w_* for each utility: their own weights where these add up to something, else the defaults.

    What a search gives nothing to tell homes apart by counts nothing: travel without a workplace (else it counts by its
    importance), size without limits, taste without a wish, quality without an index. If nothing is left, the defaults hold.
    """
    given = F.coalesce(F.aggregate("user_weights", F.lit(0.0), lambda a, x: a + x), F.lit(0.0)) > 0
    raw = {k: F.when(given, F.col("user_weights")[i]).otherwise(C.WEIGHTS[k]) for i, k in enumerate(UTILITIES)}
    placed = F.col("workplace_lat").isNotNull() & F.col("workplace_lon").isNotNull()
    raw["commute"] = F.when(placed, raw["commute"] * (F.col("commute_importance") / C.COMMUTE_IMPORTANCE)).otherwise(0.0)
    raw["area"] = F.when(F.col("min_area").isNull() & F.col("max_area").isNull(), 0.0).otherwise(raw["area"])
    raw["soft"] = F.when(F.col("soft_vec").isNull(), 0.0).otherwise(raw["soft"])
    if not has_quality:
        raw["quality"] = F.lit(0.0)
    rows = intents.select("*", *[raw[k].alias(f"__{k}") for k in UTILITIES]).withColumn("__sum", sum((F.col(f"__{k}") for k in UTILITIES), F.lit(0.0)))
    rows = rows.select("*", *[F.when(F.col("__sum") > 0, F.try_divide(f"__{k}", "__sum")).otherwise(C.WEIGHTS[k]).alias(f"w_{k}") for k in UTILITIES])
    return rows.drop("__sum", *[f"__{k}" for k in UTILITIES])


def weights_from_importance(levels: str) -> Column:
    """An intent's own weights from a map of utility to low, normal or high; what is not named or unknown is normal."""
    steps = F.create_map(*[F.lit(x) for kv in C.IMPORTANCE.items() for x in kv])
    level = lambda k: F.try_element_at(steps, F.try_element_at(F.col(levels), F.lit(k)))
    return F.array(*[C.WEIGHTS[k] * F.coalesce(level(k), F.lit(1.0)) for k in UTILITIES])


def clean(extracted: DataFrame, places: DataFrame, defaults: dict) -> DataFrame:
    """Searches as a model read them (columns as in an intent, workplace_name besides), made whole: a null where there is a default is
    the default, a named workplace without a point gets the point of places (name, lat, lon), and a point outside the city is none."""
    rows = extracted.join(places.select(F.col("name").alias("workplace_name"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon")), "workplace_name", "left")
    none = F.col("workplace_lat").isNull() | F.col("workplace_lon").isNull()
    for c in ("lat", "lon"):
        rows = rows.withColumn(f"__{c}", F.when(none, F.coalesce(f"__{c}", f"workplace_{c}")).otherwise(F.col(f"workplace_{c}")))
    inside = in_box(F.col("__lat"), F.col("__lon"), C.CITY)
    rows = rows.withColumn("workplace_lat", F.when(inside, F.col("__lat"))).withColumn("workplace_lon", F.when(inside, F.col("__lon"))).drop("__lat", "__lon")
    return rows.select(*[F.coalesce(c, F.lit(defaults[c])).alias(c) if defaults.get(c) is not None else F.col(c) for c in rows.columns])


def assemble(intents: DataFrame, panels: DataFrame, keys: DataFrame, key: str = "search_id") -> DataFrame:
    """Searches overlaid with what their panel says: a null leaves a field as it is, a flag only turns on, the market is always the
    panel's, and area names become keys, by keys (name, area_key), in their order and once each."""
    over = panels.select(key, *[F.col(c).alias(f"__{c}") for c in panels.columns if c != key])
    rows = intents.join(over, key, "left")
    kinds = dict(intents.dtypes)
    for c in (c for c in panels.columns if c not in (key, "area_names")):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(False)) | F.coalesce(f"__{c}", F.lit(False)) if kinds.get(c) == "boolean" else F.coalesce(f"__{c}", c))
    named = panels.select(key, F.posexplode("area_names").alias("__pos", "name")).join(keys.select("name", "area_key"), "name")
    first = named.groupBy(key, "area_key").agg(F.min("__pos").alias("__pos"))
    listed = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "area_key"))), lambda x: x.area_key).alias("area_keys"))
    return rows.drop("area_keys", *[f"__{c}" for c in panels.columns if c != key]).join(listed, key, "left").withColumn("area_keys", F.coalesce("area_keys", F.array().cast("array<string>")))


def prefilter() -> Column:
    """The exact conditions of a pair. A home without an area passes here; containment decides about it later."""
    asked = {"wants_parking": F.col("has_parking"), "wants_storage": F.col("has_storage"), "wants_balcony": F.col("has_balcony"), "wants_images": F.col("image_count") > 0, "full_deposit_only": F.col("is_full_deposit"), "convertible_only": F.col("can_convert")}
    ok = F.lit(True)
    for flag, has in asked.items():
        ok = ok & (~F.col(flag) | has)
    for low, x in (("min_rooms", "rooms"), ("min_floor", "floor"), ("min_build_year", "build_year"), ("min_deposit", "deposit"), ("min_rent", "rent")):
        ok = ok & (F.col(low).isNull() | F.coalesce(F.col(x) >= F.col(low), F.lit(False)))
    ok = ok & (F.col("max_floor").isNull() | (F.col("floor") <= F.col("max_floor")))
    return ok & ((F.size("area_keys") == 0) | F.col("area_key").isNull() | F.array_contains("area_keys", F.col("area_key")))


def candidates(listings: DataFrame, intents: DataFrame) -> DataFrame:
    """Pairs of a listing and a search of its market that pass the exact conditions.

    A checked small table of searches goes to every task. A large one is dealt by market and size: a search to the bins that its area
    band touches, a listing to its one bin; adaptive execution splits bins that are hot.
    """
    wanted = intents.withColumn("is_shared", F.col("living_kind") == "shared")
    if intents.limit(FEW_INTENTS + 1).count() <= FEW_INTENTS:
        pairs = listings.join(F.broadcast(wanted), "is_shared")  # FEW_INTENTS rows at most
    else:
        at = lambda x: F.least(F.floor(x / BIN_SQM), F.lit(LAST_BIN))
        low = F.greatest(at(F.coalesce(F.col("min_area") * (1 - C.AREA_BAND), F.lit(0.0))), F.lit(0))
        high = F.greatest(at(F.coalesce(F.col("max_area") * (1 + C.AREA_BAND), F.lit(float(BIN_SQM * LAST_BIN)))), low)
        pairs = listings.withColumn("__bin", F.greatest(at(F.col("area_sqm")), F.lit(0))).join(wanted.withColumn("__bin", F.explode(F.sequence(low, high))), ["is_shared", "__bin"]).drop("__bin")
    return pairs.filter(prefilter())


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed one time: conditions on them stay above, where Spark would else compute them again in a filter."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_split(pairs: DataFrame) -> DataFrame:
    d, r = resolve_split(F.col("deposit"), F.col("rent"), F.col("can_convert"), F.col("convertible_deposit_max"), F.col("max_deposit"), F.col("persona"))
    return once(pairs, split_deposit=d, split_rent=r)


def hard_mask() -> Column:
    """Beyond the exact conditions: containment in a drawn area, the area band, and the ceilings, with their tolerance, on the converted split."""
    d, r = F.nullif(F.col("max_deposit"), F.lit(0)), F.nullif(F.col("max_rent"), F.lit(0))
    top = C.BUDGET_CEILING
    both = d.isNotNull() & r.isNotNull()
    cost = tmc(F.col("split_deposit"), F.col("split_rent"))
    return hard_mask_without_split() & (d.isNull() | (F.col("split_deposit") <= d * top)) & (r.isNull() | (F.col("split_rent") <= r * top)) & (~both | (cost <= top * tmc(d, r)))


def hard_mask_without_split() -> Column:
    """Containment in a drawn area, and the area band."""
    inside = (F.size("area_keys") == 0) | F.arrays_overlap("area_keys", "inside_keys")
    band = (F.col("min_area").isNull() | (F.col("area_sqm") >= F.col("min_area") * (1 - C.AREA_BAND))) & (F.col("max_area").isNull() | (F.col("area_sqm") <= F.col("max_area") * (1 + C.AREA_BAND)))
    return inside & band


def u_budget() -> Column:
    ratio = budget_ratio(F.col("split_deposit"), F.col("split_rent"), F.col("max_deposit"), F.col("max_rent"))
    cost = tmc(F.col("deposit"), F.col("rent"))
    market = F.when(F.col("city_tmc") <= 0, 1.0).otherwise(F.col("city_tmc") / (F.col("city_tmc") + cost))
    return F.when(ratio.isNull(), market).when(ratio <= 1, 1 - 0.2 * ratio).otherwise(0.8 * F.exp(-C.FINANCIAL_DECAY * (ratio - 1)))


def u_value() -> Column:
    per = F.try_divide(tmc(F.col("deposit"), F.col("rent")), F.col("area_sqm"))
    return F.when((F.col("baseline") <= 0) | per.isNull(), 0.5).when(per <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(F.col("baseline"), per) / C.VALUE_CAP))


def u_area() -> Column:
    low, high, x = F.col("min_area"), F.col("max_area"), F.col("area_sqm")
    ideal = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).otherwise(F.coalesce(high, low).cast("double"))
    near = F.greatest(F.lit(0.0), 1 - F.pow(F.try_divide(F.abs(x - ideal), ideal), F.lit(1.5)))
    return F.when(ideal.isNull() | (high.isNull() & (x >= low)) | (ideal <= 0), 1.0).otherwise(near)


def u_amenity() -> Column:
    has = {k: F.col(k) for k in C.AMENITIES}
    has["has_elevator"] = F.col("has_elevator") | (F.col("floor") <= 1)
    asked = {k: F.col(k.replace("has_", "wants_")) for k in C.AMENITIES}
    some = F.greatest(*asked.values())
    total = sum((F.when(~some | asked[k], w).otherwise(0.0) for k, w in C.AMENITIES.items()), F.lit(0.0))
    got = sum((F.when((~some | asked[k]) & has[k], w).otherwise(0.0) for k, w in C.AMENITIES.items()), F.lit(0.0))
    return got / total


def u_metro() -> Column:
    return 1 / (1 + F.exp(C.METRO_K * (F.col("metro_walk_mins") - C.METRO_MIDPOINT)))


def with_stops(pairs: DataFrame, near: DataFrame, far: DataFrame) -> DataFrame:
    """pairs with stops and far_minutes, as transit.stops_near and stops_far give them by search: only searches by the network have any."""
    placed = pairs.withColumn("cell_row", cell(F.col("lat"), transit.STOP_CELL)).withColumn("cell_col", cell(F.col("lon"), transit.STOP_CELL))
    return placed.join(near, ["search_id", "cell_row", "cell_col"], "left").drop("cell_row", "cell_col").join(far, ["search_id", "stop_id"], "left")


def commute_minutes() -> Column:
    """From a listing to its search's workplace, null without one: on foot, by car, or by the better of walking and the network.

    The network is left at a station within reach, else at the listing's nearest one (stop_meters): see with_stops.
    """
    ends = [F.col(c) for c in ("lat", "lon", "workplace_lat", "workplace_lon")]
    walk = manhattan_m(*ends) / C.WALK_M_PER_MIN
    jam = in_box(ends[0], ends[1], C.ZONE) | in_box(ends[2], ends[3], C.ZONE)
    drive = haversine_km(*ends) / C.DRIVE_KMH * 60 * F.when(jam, C.CONGESTION).otherwise(1.0)
    net = transit.net_minutes(ends[0], ends[1])
    mode = F.col("commute_mode")
    other = F.raise_error(F.concat(F.lit("unknown commute mode: "), F.coalesce(mode, F.lit("null")))).cast("double")
    minutes = F.when(mode == "walk", walk).when(mode == "drive", drive).when(mode == "transit", F.least(walk, net)).otherwise(other)
    return F.when(F.col("workplace_lat").isNotNull() & F.col("workplace_lon").isNotNull(), minutes)


def u_commute() -> Column:
    """1 without a workplace."""
    return F.when(F.col("commute_mins").isNull(), 1.0).otherwise(1 / (1 + F.exp(C.COMMUTE_K * (F.col("commute_mins") - F.col("max_commute")))))


def u_quality() -> Column:
    return F.coalesce(F.col("quality"), F.lit(C.NEUTRAL_QUALITY))


def u_soft() -> Column:
    """1 where either vector is missing."""
    return F.when(F.col("wish").isNull() | F.col("embedding").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(dot("wish", "embedding"), norm("wish") * F.col("embedding_norm")), F.lit(0.0)))))


def u_freshness() -> Column:
    return F.exp(-F.greatest(F.lit(0), F.col("building_age")) / C.FRESHNESS_YEARS)


def elevator_penalty() -> Column:
    """For stairs without a lift: by the floor, and by how much the search minds."""
    deficit = F.when(F.col("has_elevator") | (F.col("floor") <= 1), 0.0).otherwise(F.least(F.lit(1.0), (F.col("floor") - 1) / (C.LIFT_TOP_FLOOR - 1)))
    share = C.WEIGHTS["amenity"] / sum(C.WEIGHTS.values())
    emphasis = F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.col("w_amenity") / share))
    strength = F.when(F.col("wants_elevator"), C.LIFT_STRENGTH_ASKED).otherwise(C.LIFT_STRENGTH)
    return 1 - F.least(F.lit(C.LIFT_MOST), strength * emphasis) * deficit


def structural_penalty() -> Column:
    """elevator_penalty, and for living below ground."""
    return F.col("elevator_penalty") * F.when(F.col("floor") < 0, C.BASEMENT_PENALTY).otherwise(1.0)


def scored(listings: DataFrame, intents: DataFrame, near: DataFrame, far: DataFrame) -> DataFrame:
    """Every pair that passes, with its utilities u_*, penalties and score. Utilities of the listing alone are computed below the join.

    listings: with area_key, inside_keys, metro_walk_mins, baseline, city_tmc, quality, stop_id and stop_meters (the nearest station),
    embedding and its norm. intents: with wish (a vector), null where a search has none. near, far: the searches' minutes by station.
    """
    own = listings.withColumn("u_value", u_value()).withColumn("u_metro", u_metro()).withColumn("u_freshness", u_freshness()).withColumn("u_quality", u_quality())
    # Long arrays go first, before rows are copied from step to step.
    pairs = candidates(own, weights(intents)).withColumn("u_soft", u_soft()).drop("embedding", "embedding_norm", "wish", "user_weights", "ring")
    pairs = with_stops(pairs, near, far).withColumn("commute_mins", commute_minutes()).drop("stops", "stop_id", "stop_meters", "far_minutes")
    pairs = with_split(pairs).filter(hard_mask()).withColumn("elevator_penalty", elevator_penalty())
    pairs = once(pairs, u_commute=u_commute(), u_budget=u_budget(), u_area=u_area(), u_amenity=u_amenity(), penalty=structural_penalty())
    total = sum((F.col(f"w_{k}") * F.col(f"u_{k}") for k in UTILITIES), F.lit(0.0))
    return once(pairs, score=total * F.col("penalty"))


def ranked(listings: DataFrame, intents: DataFrame, near: DataFrame, far: DataFrame, most: int = C.STORED_ROWS) -> DataFrame:
    """search_id, rank and the pair, best first, ids break ties; the first `most` of each search. Scores are compared to nine places."""
    kept = passing(listings, intents, near, far)
    order = Window.partitionBy("search_id").orderBy(F.desc(F.round("score", 9)), "id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def passing(listings: DataFrame, intents: DataFrame, near: DataFrame, far: DataFrame) -> DataFrame:
    """Every pair with a score that counts, unranked."""
    return scored(listings, intents, near, far).filter(F.col("score") >= C.LEAST_SCORE)


def rank_all(rows: DataFrame, bins: int = RANK_BINS) -> DataFrame:
    """rows (search_id, id, score, ...) with the rank of each in its search, however many a search has.

    A search's rows fall into bins of their score. Bins are counted before anything is sent, and what stands in better bins is added to
    the place in a row's own, so a search that fits all homes is sorted by as many tasks as it has bins. Scores that are equal to nine places
    stand by id, in one bin. Rows are read twice: they are kept in between, so give the columns that are wanted.
    """
    kept = cut(rows.withColumn("__bin", F.floor((1 - F.round("score", 9)) * bins)))
    counts = kept.groupBy("search_id", "__bin").agg(F.count(F.lit(1)).alias("__n"))
    better = Window.partitionBy("search_id").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
    offsets = counts.select("search_id", "__bin", F.coalesce(F.sum("__n").over(better), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("search_id", "__bin").orderBy(F.desc(F.round("score", 9)), "id"))
    placed = kept.withColumn("rank", own).join(offsets, ["search_id", "__bin"])
    return placed.withColumn("rank", F.col("rank") + F.col("__before")).drop("__bin", "__before")


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    return rows.filter(F.col("rank").between((number - 1) * size + 1, number * size))


def head_reference(rows: DataFrame, head: int = C.HEAD_ROWS) -> DataFrame:
    """search_id, head_area, head_metro: medians of the head of each ranking."""
    return rows.filter(F.col("rank") <= head).groupBy("search_id").agg(F.median("area_sqm").alias("head_area"), F.median("metro_walk_mins").alias("head_metro"))


def against_all(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Every row with every one of a stated set of queries: the queries go to every task while they are few, else both are dealt in blocks."""
    if asked.limit(FEW_INTENTS + 1).count() <= FEW_INTENTS:
        return rows.withColumn("__all", F.lit(0)).join(F.broadcast(asked.withColumn("__all", F.lit(0).cast("int"))), "__all").drop("__all")  # FEW_INTENTS rows at most
    blocks = F.sequence(F.lit(0), F.lit(QUERY_BLOCKS - 1))
    block = F.pmod(F.xxhash64(*asked.columns), F.lit(QUERY_BLOCKS)).cast("int")
    return rows.withColumn("__all", F.explode(blocks)).join(asked.withColumn("__all", block), "__all").drop("__all")


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str, b: str) -> Column:
    """0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def cosines(rows: DataFrame, asked: DataFrame, id_col: str = "vec_id", query_col: str = "query_id") -> DataFrame:
    """query_col, id_col, similarity of every row (id_col, embedding) with every query (query_col, e); norms are taken once a vector, rows are dealt to all tasks."""
    dealt = rows.select(id_col, "embedding", norm("embedding").alias("__n")).repartition(rows.sparkSession.sparkContext.defaultParallelism, id_col)
    pairs = against_all(dealt, asked.select(query_col, "e", norm("e").alias("__q")))
    return pairs.select(query_col, id_col, F.coalesce(F.try_divide(dot("embedding", "e"), F.col("__n") * F.col("__q")), F.lit(0.0)).alias("similarity"))


def below_head(rows: DataFrame, head: DataFrame) -> DataFrame:
    """The passing rows that are not in the head of their search: who is in it decides, no rank beyond it is needed."""
    return rows.join(head.select("search_id", "id"), ["search_id", "id"], "left_anti")


def trade_off(rows: DataFrame, head: DataFrame) -> DataFrame:
    """search_id, id, sentence of rows below the head (rows, head: see below_head) that are much larger than its median at a small price in
    budget or walk, whatever their rank.

    Only what the search's weights speak of is named, and a named axis that costs too much silences the sentence.
    """
    text = lambda x: digits_persian(x.cast("bigint"))
    say = TRADE_WORDS
    below = rows.join(head_reference(head), "search_id")
    below = below.filter((F.col("head_area") > 0) & ((F.col("area_sqm") - F.col("head_area")) / F.col("head_area") >= C.TRADE_AREA))
    ratio = budget_ratio(F.col("split_deposit"), F.col("split_rent"), F.col("max_deposit"), F.col("max_rent"))
    over, extra = F.bround((ratio - 1) * 100), F.col("metro_walk_mins") - F.col("head_metro")
    money_counts = ratio.isNotNull() & (F.col("w_budget") >= C.TRADE_WEIGHT)
    walk_counts = F.col("w_metro") >= C.TRADE_WEIGHT
    below = below.filter((~money_counts | (over <= C.TRADE_BUDGET_PERCENT)) & (~walk_counts | (F.bround(extra) <= 0) | (extra <= C.TRADE_WALK)) & (money_counts | walk_counts))
    gains = F.array_compact(F.array(
        F.concat(text(F.bround(F.col("area_sqm") - F.col("head_area"))), F.lit(say["larger"])),
        F.when(money_counts & (over <= 0), say["in_budget"]),
        F.when(walk_counts & (F.bround(extra) <= 0), say["near_metro"]),
    ))
    costs = F.array_compact(F.array(
        F.when(money_counts & (over > 0), F.concat(text(over), F.lit(say["over_budget"]))),
        F.when(walk_counts & (F.bround(extra) > 0), F.concat(text(F.bround(extra)), F.lit(say["longer_walk"]))),
    ))
    tail = F.when(F.size(costs) > 0, F.concat(F.lit(say["but"]), F.array_join(costs, say["and"]))).otherwise("")
    return below.select("search_id", "id", F.concat(F.lit(say["this"]), F.array_join(gains, say["and"]), tail, F.lit(".")).alias("sentence"))


def store(rows: DataFrame, path: str) -> None:
    """Keep the ranking in files by search, so that pages are read without ranking again."""
    rows.write.mode("overwrite").partitionBy("search_id").parquet(path)
