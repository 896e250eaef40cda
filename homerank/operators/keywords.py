"""Titles and keywords of areas from the named things on the map inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize
from .iterate import cut

# Words before a name that nobody types, labels of offices, beginnings of names that title no area, and how many names
# of each kind an area takes.
GENERIC_PREFIX = r"(?U)^(?:(?:بزرگراه|اتوبان|آزادراه|خیابان|خ\.|بلوار|بلوار شهید|میدان|میدان شهید|کوچه|پل|تقاطع|فلکه|شهید)\s+)+"
ADMIN_LABEL = r"(?U)^(?:منطقه|ناحیه|زون)\s*[۰-۹0-9]"
LANDMARK_TITLE = r"(?U)^(?:بوستان|پارک|پاساژ|مرکز خرید|مجتمع تجاری|بازار|بیمارستان|درمانگاه|دانشگاه|دانشکده|ورزشگاه|استادیوم|فرودگاه|ایستگاه|مترو|مصلی|مسجد|امامزاده|برج|هتل|موزه|فرهنگسرا)\b"
TAKEN = {"places": 4, "roads": 6, "transit": 3, "landmarks": 3}
PERSIAN, LEAST_LETTERS = "[؀-ۿ]", 3


def form(name: Column) -> Column:
    """A name normalised, without diacritics and with joiners as spaces."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "[ً-ْ]", ""), "[​-‏]", " ")
    return F.trim(F.regexp_replace(normalize(bare), r"(?U)\s+", " "))


def squashed(name: Column) -> Column:
    return F.replace(form(name), F.lit(" "), F.lit(""))


def clean_name(name: Column) -> Column:
    """What a person would type of a label on the map: without the words before it, however many stand there; null for labels in other
    letters, labels of offices and what is too short."""
    bare = F.trim(F.regexp_replace(form(name), GENERIC_PREFIX, ""))
    return F.when(bare.rlike(PERSIAN) & (F.length(bare) >= LEAST_LETTERS) & ~bare.rlike(ADMIN_LABEL), bare)


def bucket(tags: Column) -> Column:
    """The kind of a thing by its tags (a map): places, roads, transit or landmarks."""
    tag = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    station = (tag("railway") == "station") | (tag("public_transport") == "station")
    return F.when(tag("place") != "", "places").when(tag("highway") != "", "roads").when(station, "transit").otherwise("landmarks")


def area_names(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(area_key, bucket, rank, name: the first different names of each kind; area_key, label: the first place's name that can be a title)
    of features (area_key, pos, name, tags).

    Names are made distinct before they are ranked, in tasks and then by name, and each task passes on no more of an area's than are
    taken, so an area with a third of all features is no hot group.
    """
    named = features.select("area_key", "pos", bucket(F.col("tags")).alias("bucket"), clean_name(F.col("name")).alias("name")).filter("name IS NOT NULL AND area_key IS NOT NULL")
    first = cut(named.groupBy("area_key", "bucket", "name").agg(F.min("pos").alias("pos")))
    rank = F.row_number().over(Window.partitionBy("area_key", "bucket").orderBy("pos", "name"))
    most = F.element_at(F.create_map(*[F.lit(x) for kv in TAKEN.items() for x in kv]), F.col("bucket"))
    heads = first.withColumn("rank", rank).filter(F.col("rank") <= max(TAKEN.values())).filter(F.col("rank") <= most).drop("pos")
    labels = first.filter((F.col("bucket") == "places") & ~F.col("name").rlike(LANDMARK_TITLE))
    return heads, labels.groupBy("area_key").agg(F.min_by("name", F.struct("pos", "name")).alias("label"))


def poi_keywords(areas: DataFrame, features: DataFrame) -> DataFrame:
    """area_key, title, keywords of areas (area_key, title or null, district or null) by the features (area_key, pos, name, tags) inside them.

    An area without a title takes the first place's name that is no landmark's; one that finds none is left out. Keywords are the first
    names of places, roads, transit and landmarks, in this order, each form once and not the title's. Areas of one name get their district
    behind it, and then the plain name and its parts are keywords too, ahead of the others. Ties in pos go by name. Nulls are silence.
    """
    heads, labels = area_names(features)
    kinds = F.element_at(F.create_map(*[F.lit(x) for kv in zip(TAKEN, range(len(TAKEN))) for x in kv]), F.col("bucket"))
    lists = heads.groupBy("area_key").agg(F.transform(F.array_sort(F.collect_list(F.struct(kinds.alias("kind"), "rank", "name"))), lambda x: x["name"]).alias("names"))
    titled = areas.join(labels, "area_key", "left").withColumn("base", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "label")).filter("base IS NOT NULL")
    titled = titled.withColumn("__form", squashed(F.col("base")))
    shared = titled.groupBy("__form").agg(F.count(F.lit(1)).alias("__same"))
    # Names are few an area: what is taken of each kind.
    whole = titled.join(shared, "__form").join(lists, "area_key", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    forms = F.transform("names", lambda n: F.struct(n.alias("name"), squashed(n).alias("form")))
    once = F.filter(forms, lambda x, i: (x["form"] != "") & (x["form"] != F.col("__form")) & (F.array_position(F.transform(forms, lambda y: y["form"]), x["form"]) == i + 1))
    whole = whole.withColumn("keywords", F.transform(once, lambda x: x["name"]))
    title = F.when((F.col("__same") > 1) & (F.coalesce("district", F.lit("")) != ""), F.concat("base", F.lit(" ("), "district", F.lit(")"))).otherwise(F.col("base"))
    parts = F.filter(F.transform(F.split("base", "[-–—/]"), lambda p: F.trim(p)), lambda p: p != "")
    whole = whole.withColumn("shown", title)
    new = F.filter(F.concat(F.array("base"), parts), lambda v: squashed(v) != squashed(F.col("shown")))
    ahead = F.aggregate(new, F.col("keywords"), lambda acc, v: F.when(F.array_contains(acc, v), acc).otherwise(F.concat(F.array(v), acc)))
    return whole.select("area_key", F.col("shown").alias("title"), ahead.alias("keywords"))
