"""Market statistics over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.geo import cell
from ..functions.money import tmc
from .iterate import cut

#: Accuracy of the sketches that bracket medians, and values of a group, at most, that one task takes whole.
SKETCH, WHOLE_GROUP = 10_000, 200_000


def cost_per_sqm():
    return F.try_divide(tmc(F.col("deposit"), F.col("rent")), F.col("area_sqm"))


def medians(rows: DataFrame, keys: list[str], value: str, whole: int = WHOLE_GROUP) -> DataFrame:
    """keys, median, n: the exact median of `value` in each group, null values left out.

    Groups are counted first. If none has more than `whole` values, each is small enough for one task. Otherwise a sketch brackets the middle first, with a map-side part; then values below, at the ends of and between the bracket are
    counted, and only those strictly between (some ten-thousandths of a group) are gathered. So neither a hot group nor a whole table
    goes through one task, and equal values are only counted. Both passes read the same narrow columns.
    """
    known = rows.select(*keys, F.col(value).cast("double").alias("__x")).filter("__x IS NOT NULL")
    most = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= whole:
        return known.groupBy(*keys).agg(F.median("__x").alias("median"), F.count(F.lit(1)).alias("n"))
    low, high = 0.5 - 1.5 / SKETCH, 0.5 + 1.5 / SKETCH
    sketch = known.groupBy(*keys).agg(F.percentile_approx("__x", F.array(F.lit(low), F.lit(high)), SKETCH).alias("__b"), F.count(F.lit(1)).alias("n"))
    x, a, b = F.col("__x"), F.col("__a"), F.col("__c")
    if keys:
        marks = sketch.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b")[0].alias("__a"), F.col("__b")[1].alias("__c"), "n")
        on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    else:
        marks = sketch.select(F.lit(1).alias("__one"), F.col("__b")[0].alias("__a"), F.col("__b")[1].alias("__c"), "n")
        known = known.withColumn("__one", F.lit(1))
        on = "__one"
        marks = F.broadcast(marks)  # one row
    counted = known.join(marks, on).groupBy(*keys).agg(
        F.count_if(x < a).alias("__below"), F.count_if(x == a).alias("__at"), F.array_sort(F.collect_list(F.when((x > a) & (x < b), x))).alias("__mid"),
        F.first("__a").alias("__a"), F.first("__c").alias("__c"), F.first("n").alias("n"),
    )
    place = lambda r: F.when(r < F.col("__below") + F.col("__at"), a).otherwise(F.coalesce(F.try_element_at("__mid", (r - F.col("__below") - F.col("__at") + 1).cast("int")), b))
    middle = (place(F.floor((F.col("n") - 1) / 2)) + place(F.floor(F.col("n") / 2))) / 2
    return counted.select(*keys, middle.alias("median"), "n")


def area_baselines(listings: DataFrame) -> DataFrame:
    """area_key, baseline, n: median cost per square metre of areas with enough listings."""
    known = listings.filter(F.col("area_key").isNotNull() & (F.col("area_sqm") > 0)).select("area_key", cost_per_sqm().alias("x"))
    # Where the areas stand may have taken a join: it is done once.
    return medians(cut(known), ["area_key"], "x").select("area_key", F.col("median").alias("baseline"), "n").filter(F.col("n") >= C.BASELINE_SAMPLES)


def city_baseline(listings: DataFrame) -> DataFrame:
    """One row: city_per_sqm, city_tmc."""
    known = listings.filter("area_sqm > 0").select(cost_per_sqm().alias("x"), tmc(F.col("deposit"), F.col("rent")).alias("y"))
    both = [medians(known, [], c).select(F.col("median").alias(name)) for c, name in (("x", "city_per_sqm"), ("y", "city_tmc"))]
    return both[0].crossJoin(both[1])  # one row each


def price_floors(listings: DataFrame, degrees: float = C.CELL_DEGREES) -> DataFrame:
    """cell_row, cell_col, price_floor, n: robust lower limits of cost per square metre where a cell has enough samples."""
    cells = ["cell_row", "cell_col"]
    rows = listings.filter("area_sqm > 0").select(cell(F.col("lat"), degrees).alias("cell_row"), cell(F.col("lon"), degrees).alias("cell_col"), cost_per_sqm().alias("x"))
    rows = rows.filter("cell_row IS NOT NULL AND cell_col IS NOT NULL")
    middle = medians(rows, cells, "x").withColumnRenamed("median", "m").filter(F.col("n") >= C.FLOOR_SAMPLES)
    apart = rows.join(middle.select(*cells, "m"), cells).select(*cells, F.abs(F.col("x") - F.col("m")).alias("off"))
    spread = medians(apart, cells, "off").select(*cells, F.col("median").alias("mad")).join(middle, cells)
    floor = F.greatest(C.FLOOR_LOW * F.col("m"), F.least(F.col("m") - C.FLOOR_MADS * F.col("mad"), C.FLOOR_HIGH * F.col("m")))
    return spread.select("cell_row", "cell_col", floor.alias("price_floor"), "n")


def without_outliers(listings: DataFrame, floors: DataFrame, degrees: float = C.CELL_DEGREES) -> DataFrame:
    """Listings that are not below their cell's floor; cells without a floor keep all."""
    placed = listings.withColumn("cell_row", cell(F.col("lat"), degrees)).withColumn("cell_col", cell(F.col("lon"), degrees))
    joined = placed.join(floors.select("cell_row", "cell_col", "price_floor"), ["cell_row", "cell_col"], "left")
    return joined.filter(F.col("price_floor").isNull() | (F.col("area_sqm") <= 0) | (cost_per_sqm() >= F.col("price_floor"))).drop("price_floor", "cell_row", "cell_col")


def posting_rate(posts: DataFrame, now: str, shard: str = "user_id", ts: str = "ts") -> DataFrame:
    """shard, posts, per_hour: posts over the hours back to the oldest; null where no time has passed."""
    hours = (F.lit(now).cast("timestamp").cast("double") - F.min(F.col(ts)).cast("timestamp").cast("double")) / 3600
    return posts.groupBy(shard).agg(F.count(F.lit(1)).alias("posts"), F.when(hours > 0, F.count(F.lit(1)) / hours).alias("per_hour"))


def quota_sample(posts: DataFrame, seen: DataFrame, quota: int, token: str, shard: str, seed: int = 7) -> DataFrame:
    """Up to quota unseen posts of each shard, drawn by a hash."""
    fresh = posts.join(seen, token, "left_anti")
    rank = F.row_number().over(Window.partitionBy(shard).orderBy(F.md5(F.concat(F.col(token).cast("string"), F.lit(f"-{seed}"))), token))
    return fresh.withColumn("__r", rank).filter(F.col("__r") <= quota).drop("__r")
