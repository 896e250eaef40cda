"""Raw posts as a crawl returns them, trees of mixed widgets as JSON text, brought to one typed row a post."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text

# Section and widget names, and the words that the rules look for.
DESCRIPTION, TITLE, MODAL = "DESCRIPTION", "TITLE", "MODAL"
TITLE_ROWS, IMAGE_ROWS = ("LEGEND_TITLE_ROW", "TITLE_ROW"), ("IMAGE_CAROUSEL", "IMAGE_SLIDER_ROW")
AMENITY_BY_ICON = {"ELEVATOR": "elevator", "PARKING": "parking", "CABINET": "storage", "STORAGE": "storage", "BALCONY": "balcony"}
AMENITY_BY_WORD = {"آسانسور": "elevator", "پارکینگ": "parking", "انباری": "storage", "بالکن": "balcony"}
AMENITIES = ("elevator", "parking", "storage", "balcony")
PUBLISHED, SUITABLE, CONVERTIBLE, DENIAL, BEFORE = "انتشار", "مناسب برای", "قابل تبدیل", "ندارد", "قبل از"
AREA, ROOMS, BUILT, FLOOR, FLOORS = "متراژ", "اتاق", "ساخت", "طبقه", "تعداد کل طبقات ساختمان"
DEFAULT_CITY, DEFAULT_CATEGORY = "تهران", "apartment-rent"
#: Phrases that lead a feature sentence, with their group; answers that count as yes, and about pets.
FEATURE_GROUPS = {"جنس کف": "floor_material", "سرمایش": "cooling", "گرمایش": "heating", "تأمین‌کننده آب گرم": "water_heater", "تامین کننده آب گرم": "water_heater", "سرویس بهداشتی": "wc_type"}
YES = ("بله", "هست", "دارد", "دارای")
PETS = {"بله": "allowed", "خیر": "not_allowed", "با توافق": "negotiable"}

_WIDGET = "struct<widget_type:string,data:variant>"
_SECTION = f"struct<section_name:string,widgets:array<{_WIDGET}>>"
_PAIR = "struct<title:string,value:string>"
_FEATURE = "struct<title:string,icon:struct<icon_name:string>,available:boolean,disabled:boolean>"
_IMAGE = "struct<image:struct<url:string>,image_url:string>"


def plain(value: Column) -> Column:
    """Texts as the crawl keeps them: digits and letters folded, without white space at the ends; null is empty."""
    return F.btrim(text.crawl_normalize(F.coalesce(value, F.lit(""))), F.lit(text.WHITE_SPACE))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed one time: what a lambda says twice, Spark computes twice."""
    return F.transform(F.array(value), f)[0]


def _at(node: Column, path: str, kind: str = "string") -> Column:
    """What stands at a path of a variant; null where the tree has no such place or another kind of value there."""
    return F.try_variant_get(node, path, kind)


def _list(node: Column, path: str, of: str) -> Column:
    """The elements of a list, read as `of` in one go: nested variants would be built anew at each level. What is not such a thing is null."""
    return F.coalesce(_at(node, path, f"array<{of}>"), F.array().cast(f"array<{of}>"))


def _number(node: Column, path: str) -> Column:
    """A number as it is (its whole part), a text's digits joined; null without any."""
    value = _at(node, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", text.first_integer(plain(_at(node, path)))).otherwise(_at(node, path, "bigint"))


def parsed(posts: DataFrame) -> DataFrame:
    """token, post (variant), widgets of posts (token, raw); what cannot be read as JSON gives a null post and no widgets."""
    return posts.select("token", F.try_parse_json("raw").alias("post")).withColumn("widgets", widget_list(F.col("post")))


def widget_list(post: Column) -> Column:
    """Every widget of a post in order, as an array: each widget of each section, after it those of an expandable one, which are in
    its section, then those of the modal page that its action loads, which are in the section MODAL.

    section_pos, widget_pos, branch (0 the widget, 1 expandable, 2 modal) and sub_pos say where it stands; data is a variant."""

    def row(i: Column, j: Column, branch: int, k: Column, section: Column, widget: Column) -> Column:
        place = [i.alias("section_pos"), j.alias("widget_pos"), F.lit(branch).alias("branch"), k.alias("sub_pos")]
        return F.struct(*place, section.alias("section"), F.coalesce(widget["widget_type"], F.lit("")).alias("widget_type"), widget["data"].alias("data"))

    nothing = F.array().cast(f"array<{_WIDGET}>")

    def of_section(s: Column, i: Column) -> Column:
        name = F.coalesce(s["section_name"], F.lit(""))

        def of_widget(w: Column, j: Column) -> Column:
            inner = F.when(w["widget_type"] == "EXPANDABLE_SECTION", _list(w["data"], "$.widget_list", _WIDGET)).otherwise(nothing)
            loads = _at(w["data"], "$.action.type") == "LOAD_MODAL_PAGE"
            modal = F.when(loads, _list(w["data"], "$.action.payload.modal_page.widget_list", _WIDGET)).otherwise(nothing)
            return F.concat(
                F.array(row(i, j, 0, F.lit(0), name, w)),
                F.transform(inner, lambda x, k: row(i, j, 1, k, name, x)),
                F.transform(modal, lambda x, k: row(i, j, 2, k, F.lit(MODAL), x)),
            )

        return F.flatten(F.transform(F.coalesce(s["widgets"], nothing), of_widget))

    return F.flatten(F.transform(_list(post, "$.sections", _SECTION), of_section))


def widgets(rows: DataFrame) -> DataFrame:
    """token, section, widget_type, section_pos, widget_pos, branch, sub_pos and data of every widget of parsed posts. A map over posts."""
    return rows.select("token", F.explode("widgets").alias("w")).select("token", "w.*")


def _of(*kinds: str, also: Callable[[Column], Column] | None = None) -> Column:
    return F.filter("widgets", lambda w: w["widget_type"].isin(*kinds) & (also(w) if also else F.lit(True)))


def _each(rows: Column, f: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(rows, f))


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def _full(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull() & (x != ""))


def _map(pairs: Column) -> Column:
    """A map of pairs (key, value), of which the last one of a key counts."""
    last = lambda all_, k: _last(F.filter(all_, lambda p: p["key"] == k))["value"]
    keyed = lambda all_, keys: F.map_from_arrays(keys, F.transform(keys, lambda k: last(all_, k)))
    return _once(pairs, lambda all_: _once(F.array_distinct(F.transform(all_, lambda p: p["key"])), lambda keys: keyed(all_, keys)))


def _pairs(rows: Column) -> Column:
    return F.transform(rows, lambda x: F.struct(plain(x["title"]).alias("key"), plain(x["value"]).alias("value")))


def chips() -> Column:
    """(label, chip) of a post's modal chips in order: one fold over its widgets carries the last label. A chip before all labels has ''."""

    def step(state: Column, w: Column) -> Column:
        said = plain(_at(w["data"], "$.text"))
        labels = (w["widget_type"] == "DESCRIPTION_ROW") & (w["section"] == MODAL) & ~F.coalesce(_at(w["data"], "$.text"), F.lit("")).contains(PUBLISHED)
        shown = _full(F.transform(_list(w["data"], "$.chip_list.chips", "struct<text:string>"), lambda c: plain(c["text"])))
        new = F.transform(shown, lambda c: F.struct(state["label"].alias("label"), c.alias("chip")))
        own = (w["widget_type"] == "WRAPPER_ROW") & (w["section"] == MODAL)
        return F.struct(F.when(labels, said).otherwise(state["label"]).alias("label"), F.when(own, F.concat(state["chips"], new)).otherwise(state["chips"]).alias("chips"))

    start = F.struct(F.lit("").alias("label"), F.array().cast("array<struct<label:string,chip:string>>").alias("chips"))
    return F.aggregate("widgets", start, step, lambda state: state["chips"])


def _amenity(title: Column, icon: Column) -> Column:
    """By the icon's name, else by the first known word in the title."""
    words = [F.when(title.contains(w), key) for w, key in AMENITY_BY_WORD.items()]
    icons = F.create_map(*[F.lit(x) for pair in AMENITY_BY_ICON.items() for x in pair])
    return F.coalesce(F.try_element_at(icons, F.coalesce(icon, F.lit(""))), *words)


def features() -> Column:
    """(headline, title, key, has) of a post's features in order: headline rows with what they say, and those of lists that are no
    remark on conversion, not empty and not disabled."""

    def of(item: Column, headline: bool) -> Column:
        def said(title: Column) -> Column:
            has = ~title.contains(DENIAL)
            if headline:
                has = has & F.coalesce(item["available"], F.lit(True))
            key = _amenity(title, item["icon"]["icon_name"])
            off = F.lit(False) if headline else title.contains(CONVERTIBLE) | (title == "") | F.coalesce(item["disabled"], F.lit(False))
            return F.struct(F.lit(headline).alias("headline"), title.alias("title"), key.alias("key"), has.alias("has"), off.alias("off"))

        return _once(plain(item["title"]), said)

    def of_widget(w: Column) -> Column:
        heads = F.transform(_list(w["data"], "$.items", _FEATURE), lambda x: of(x, True))
        own = F.transform(F.array(_at(w["data"], "$", _FEATURE)), lambda x: of(x, False))
        return F.when(w["widget_type"] == "GROUP_FEATURE_ROW", heads).otherwise(own)

    return F.filter(_each(_of("GROUP_FEATURE_ROW", "FEATURE_ROW"), of_widget), lambda x: ~x["off"])


def _has(name: str) -> Column:
    """The last headline on an amenity, else the first row of a list; null where the post is silent."""
    heads = F.filter("features", lambda x: x["headline"] & (x["key"] == name))
    rows = F.filter("features", lambda x: ~x["headline"] & (x["key"] == name))
    return F.coalesce(_last(heads)["has"], F.try_element_at(rows, F.lit(1))["has"])


def _location() -> Column:
    """precision, lat, lon, radius_meters by which object the last map row has: exact_data, else fuzzy_data, else neither."""
    data = _last(_of("MAP_ROW"))["data"]
    exact, fuzzy = _at(data, "$.location.exact_data", "variant"), _at(data, "$.location.fuzzy_data", "variant")
    kind = F.when(exact.isNotNull(), "EXACT").when(fuzzy.isNotNull(), "FUZZY")
    point = lambda x: F.when(exact.isNotNull(), _at(exact, f"$.point.{x}", "double")).otherwise(_at(fuzzy, f"$.point.{x}", "double"))
    radius = F.when(exact.isNull(), _at(fuzzy, "$.radius", "double"))
    return F.struct(kind.alias("precision"), point("latitude").alias("lat"), point("longitude").alias("lon"), radius.alias("radius_meters"))


def extract(rows: DataFrame) -> DataFrame:
    """One typed row for each parsed post that could be read; a map over posts, nothing is shuffled.

    Money and its ceiling come from the slider, else from the analytics block; area, rooms and year from the specification, floors
    from the attributes; amenities as `_has` says. Lists of features and of whom it suits are sorted, without repeats.
    """
    title = _last(_full(F.transform(_of(*TITLE_ROWS, also=lambda w: w["section"] == TITLE), lambda w: _at(w["data"], "$.title"))))
    texts = _of("DESCRIPTION_ROW", also=lambda w: w["section"] == DESCRIPTION)
    published = F.transform(_of("DESCRIPTION_ROW", also=lambda w: w["section"] != DESCRIPTION), lambda w: _at(w["data"], "$.text"))
    slider = _last(_of("RENT_SLIDER"))["data"]
    images = F.transform(_each(_of(*IMAGE_ROWS), lambda w: _list(w["data"], "$.items", _IMAGE)), lambda x: F.coalesce(F.when(x["image"]["url"] != "", x["image"]["url"]), x["image_url"]))
    attributes = F.filter(_pairs(F.transform(_of("UNEXPANDABLE_ROW"), lambda w: _at(w["data"], "$", _PAIR))), lambda p: (p["key"] != "") & (p["value"] != ""))
    converts = F.exists(_of("FEATURE_ROW"), lambda w: plain(_at(w["data"], "$.title")).contains(CONVERTIBLE))
    read = rows.filter("post IS NOT NULL").select("token", "post", "widgets", features().alias("features"), chips().alias("chips"))
    read = read.select(
        "token", "post", "features", title.alias("__title"),
        F.coalesce(_at(_last(texts)["data"], "$.text"), F.lit("")).alias("description"),
        plain(_last(F.filter(published, lambda t: t.contains(PUBLISHED)))).alias("published_text"),
        F.coalesce(_last(_full(F.transform(_of("EXPANDABLE_SECTION"), lambda w: plain(_at(w["data"], "$.title"))))), F.lit("")).alias("location_text"),
        _map(_pairs(_each(_of("GROUP_INFO_ROW"), lambda w: _list(w["data"], "$.items", _PAIR)))).alias("specs"), _map(attributes).alias("attributes"),
        _number(slider, "$.credit.value").alias("__deposit"), _number(slider, "$.rent.value").alias("__rent"),
        _number(slider, "$.credit.transformed_value").alias("convertible_deposit_max"), (slider.isNotNull() | converts).alias("can_convert"),
        _full(images).alias("images"), _location().alias("__map"),
        F.array_sort(F.array_distinct(F.transform(F.filter("chips", lambda c: c["label"].contains(SUITABLE)), lambda c: c["chip"]))).alias("suitable_for"),
    )
    post, number = F.col("post"), lambda c: text.first_integer(c)
    deposit, rent = F.coalesce("__deposit", _number(post, "$.webengage.credit")), F.coalesce("__rent", _number(post, "$.webengage.rent"))
    spec = lambda key: F.try_element_at("specs", F.lit(key))
    floors = F.regexp_extract_all(F.try_element_at("attributes", F.lit(FLOOR)), F.lit("([0-9]+)"))
    total = F.coalesce(F.try_element_at(floors, F.lit(2)).try_cast("bigint"), number(F.try_element_at("attributes", F.lit(FLOORS))))
    others = F.filter("features", lambda x: x["key"].isNull() & (~x["headline"] | x["has"]) & (x["title"] != ""))
    rate = F.lit(C.TABDIL_RATE)
    return read.select(
        "token", F.coalesce(F.nullif(plain(F.col("__title")), F.lit("")), plain(_at(post, "$.seo.web_info.title"))).alias("title"), "description",
        deposit.alias("deposit"), rent.alias("rent"), (rent + deposit * rate).cast("bigint").alias("effective_monthly_cost"), "can_convert", "convertible_deposit_max",
        F.coalesce(rent <= C.FULL_DEPOSIT_RENT, F.lit(False)).alias("is_full_deposit"),
        number(spec(AREA)).alias("area_sqm"), number(spec(ROOMS)).alias("rooms"), number(spec(BUILT)).alias("build_year"),
        F.coalesce(spec(BUILT), F.lit("")).alias("build_year_text"), F.coalesce(spec(BUILT).contains(BEFORE), F.lit(False)).alias("build_year_is_upper_bound"),
        F.try_element_at(floors, F.lit(1)).try_cast("bigint").alias("floor"), total.alias("total_floors"), *[_has(a).alias(f"has_{a}") for a in AMENITIES],
        "__map.lat", "__map.lon", F.col("__map.precision").alias("location_precision"), F.col("__map.radius_meters").alias("location_radius_meters"),
        plain(_at(post, "$.seo.web_info.district_persian")).alias("neighborhood"), _at(post, "$.webengage.district").alias("neighborhood_slug"),
        F.coalesce(F.nullif(plain(_at(post, "$.seo.web_info.city_persian")), F.lit("")), F.lit(DEFAULT_CITY)).alias("city"), "location_text",
        F.coalesce(F.nullif(_at(post, "$.webengage.cat_3"), F.lit("")), F.lit(DEFAULT_CATEGORY)).alias("category"), _at(post, "$.webengage.business_type").alias("business_type"),
        "published_text", _at(post, "$.seo.unavailable_after").alias("unavailable_after"), _at(post, "$.webengage.image_count", "bigint").alias("image_count"), "images", "attributes",
        F.array_sort(F.array_distinct(F.transform(others, lambda x: x["title"]))).alias("other_features"), "suitable_for",
    )


def feature_groups(sentences: Column) -> Column:
    """map of group to its values in order: a sentence belongs to the first phrase that leads it; empty values are dropped."""

    def grouped(s: Column) -> Column:
        key, value = F.lit(None).cast("string"), F.lit(None).cast("string")
        for phrase, group in reversed(FEATURE_GROUPS.items()):
            rest = F.trim(F.substring(s, F.lit(len(phrase) + 1), F.length(s)))
            key, value = F.when(s.startswith(phrase), group).otherwise(key), F.when(s.startswith(phrase), rest).otherwise(value)
        return F.struct(key.alias("key"), value.alias("value"))

    pairs = F.filter(F.transform(sentences, grouped), lambda p: p.key.isNotNull() & (p.value != ""))
    keys = F.array_distinct(F.transform(pairs, lambda p: p.key))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p.key == k), lambda p: p.value)))


def attribute(key: str, attributes: str = "attributes") -> Column:
    return F.try_element_at(F.col(attributes), F.lit(key))


def attribute_int(attributes: str, key: str) -> Column:
    return F.nullif(F.regexp_extract(text.prepared(attribute(key, attributes)), "[0-9]+", 0), F.lit("")).try_cast("int")


def attribute_yes(attributes: str, key: str) -> Column:
    return F.coalesce(attribute(key, attributes).isin(*YES), F.lit(False))


def pets(attributes: str, key: str = "حیوان خانگی مجاز") -> Column:
    known = F.create_map(*[F.lit(x) for kv in PETS.items() for x in kv])
    return F.try_element_at(known, F.trim(attribute(key, attributes)))
