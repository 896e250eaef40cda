"""How sought-after areas are, and how many posts to take from each shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from .market import medians


def percent_rank(column: str) -> Column:
    """Rank from 0 to 1 among the rows where column is known; equal values share their mean rank, a single row has 0.5."""
    known = F.col(column).isNotNull()
    n = F.count(column).over(Window.partitionBy())
    first = F.rank().over(Window.orderBy(F.col(column).asc_nulls_last()))  # one row for each area, never for each listing
    ties = F.count(F.lit(1)).over(Window.partitionBy(column))
    return F.when(known & (n == 1), 0.5).when(known, F.try_divide(first - 1 + (ties - 1) / 2, n - 1))


def quality_index(listings: DataFrame, areas: DataFrame) -> DataFrame:
    """area_key, score, prestige, modernity, n of areas (area_key, district, prior): cost drawn towards the district's prior, blended with the age of the homes.

    An area without listings and prior is left out. One without build years takes its district's median rank, else the middle.
    """
    homes = listings.filter("area_key IS NOT NULL AND area_sqm > 0")
    cost = (F.col("rent") + F.col("deposit") * C.TABDIL_RATE) / F.col("area_sqm")
    homes = homes.select("area_key", cost.alias("cost"), F.nullif("build_year", F.lit(0)).alias("year"))
    years = medians(homes, ["area_key"], "year").select("area_key", F.col("median").alias("year"))
    local = medians(homes, ["area_key"], "cost").withColumnRenamed("median", "local").join(years, "area_key", "full")
    # Homes without a price count too.
    local = local.drop("n").join(homes.groupBy("area_key").agg(F.count(F.lit(1)).alias("n")), "area_key")
    rows = areas.select("area_key", "district", "prior").join(local, "area_key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    both = F.when((F.col("n") >= C.PRIOR_SAMPLES) & F.col("prior").isNotNull(), F.struct("local", "prior"))
    whole = Window.partitionBy()
    scale = F.coalesce(F.try_divide(F.avg(both.local).over(whole), F.avg(both.prior).over(whole)), F.lit(1.0))
    rows = rows.withColumn("drawn", F.col("prior") * scale)
    blend = (F.col("n") * F.col("local") + C.FULL_SHRINK * F.col("drawn")) / (F.col("n") + C.FULL_SHRINK)
    rows = rows.withColumn("cost", F.coalesce(blend, "local", "drawn"))
    rows = rows.withColumn("prestige", percent_rank("cost")).withColumn("own", percent_rank("year"))
    near = F.when(F.col("district").isNotNull(), F.median("own").over(Window.partitionBy("district")))
    rows = rows.withColumn("modernity", F.coalesce("own", near, F.lit(0.5))).filter("cost IS NOT NULL")
    score = C.PRESTIGE_WEIGHT * F.col("prestige") + C.MODERNITY_WEIGHT * F.col("modernity")
    return rows.select("area_key", score.alias("score"), "prestige", "modernity", "n")


def quality_lookup(listings: DataFrame, index: DataFrame) -> DataFrame:
    """listings with quality; the middle for areas that the index does not know."""
    return listings.join(index.select("area_key", F.col("score").alias("quality")), "area_key", "left").withColumn("quality", F.coalesce("quality", F.lit(0.5)))


def fresh_rates(rates: DataFrame, now: str, ts: str = "measured") -> DataFrame:
    """Rates measured within the last two weeks."""
    return rates.filter(F.col(ts).cast("timestamp") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {C.RATE_DAYS} DAYS"))


def allocate_quotas(shards: DataFrame, rates: DataFrame, target: int) -> DataFrame:
    """shard, quota: target split by rate to a power, within limits; what the upper limit cuts off goes to shards below it, in a few passes.

    Shards without a rate take the upper median rate. A pass brings two sums to the driver, nothing else.
    """
    middle = rates.agg(F.coalesce(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY rate DESC)"), F.lit(1.0)).alias("m")).first()["m"]
    weight = F.pow(F.greatest(F.coalesce("rate", F.lit(middle)), F.lit(1e-6)), F.lit(C.QUOTA_POWER))
    rows = shards.select("shard").distinct().join(rates.select("shard", "rate"), "shard", "left").select("shard", weight.alias("weight"))
    rows = rows.withColumn("quota", F.lit(None).cast("bigint"))
    left, open_ = float(target), F.lit(True)
    for _ in range(C.QUOTA_PASSES):
        total = rows.filter(open_).agg(F.sum("weight")).first()[0]
        if total is None or left <= 0:
            break
        share = F.least(F.lit(C.MOST_QUOTA), F.greatest(F.lit(C.LEAST_QUOTA), F.bround(left * F.col("weight") / total))).cast("bigint")
        rows = rows.withColumn("quota", F.when(open_, share).otherwise(F.col("quota")))
        full = rows.filter(F.col("quota") == C.MOST_QUOTA).count()
        seen = C.MOST_QUOTA * full
        rest = max(0.0, target - seen)
        if rest == left:
            break
        left, open_ = rest, F.coalesce(F.col("quota") < C.MOST_QUOTA, F.lit(True))
    return rows.select("shard", F.coalesce("quota", F.lit(C.LEAST_QUOTA)).alias("quota"))


def uniform_quota(shards: DataFrame, target: int) -> DataFrame:
    """One row: quota for every shard when no rate is known."""
    return shards.agg(F.greatest(F.lit(C.LEAST_QUOTA), F.ceil(F.try_divide(F.lit(target), F.count_distinct("shard")))).alias("quota"))
