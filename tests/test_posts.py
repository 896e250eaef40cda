"""Posts in the shapes that a crawl returns, with the rows that follow from them by hand."""

import json
import os
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from homerank.operators import posts, records
from homerank.plans import posts as plans

FULL = {
    "sections": [
        {"section_name": "TITLE", "widgets": [{"widget_type": "LEGEND_TITLE_ROW", "data": {"title": "آپارتمان ۸۵ متري"}}, {"widget_type": "TITLE_ROW", "data": {"title": ""}}]},
        {"section_name": "DESCRIPTION", "widgets": [{"widget_type": "DESCRIPTION_ROW", "data": {"text": "خوش‌نقشه\nبا ۲ پارکینگ"}}]},
        {"section_name": "LIST_DATA", "widgets": [
            {"widget_type": "DESCRIPTION_ROW", "data": {"text": "زمان انتشار ۲ ساعت پیش"}},
            {"widget_type": "GROUP_INFO_ROW", "data": {"items": [{"title": "متراژ", "value": "۸۵"}, {"title": "ساخت", "value": "قبل از ۱۳۷۰"}, {"title": "اتاق", "value": "۲"}]}},
            {"widget_type": "UNEXPANDABLE_ROW", "data": {"title": "طبقه", "value": "۲ از ۳"}},
            {"widget_type": "UNEXPANDABLE_ROW", "data": {"title": "جهت", "value": ""}},
            {"widget_type": "RENT_SLIDER", "data": {"credit": {"value": 200000000, "transformed_value": "۳۰۰٬۰۰۰٬۰۰۰"}, "rent": {"value": "۵٬۰۰۰٬۰۰۰ تومان"}}},
            {"widget_type": "EXPANDABLE_SECTION", "data": {"title": " محله ۷ ", "widget_list": [{"widget_type": "UNEXPANDABLE_ROW", "data": {"title": "سند", "value": "تک‌برگ"}}]}},
            {"widget_type": "GROUP_FEATURE_ROW", "data": {
                "items": [{"title": "آسانسور ندارد", "icon": {"icon_name": "ELEVATOR"}}, {"title": "پارکینگ", "icon": {"icon_name": "PARKING"}, "available": False}, {"title": "گنجه", "icon": {"icon_name": "CABINET"}}, {"title": "نورگیر"}, {"title": "استخر ندارد"}],
                "action": {"type": "LOAD_MODAL_PAGE", "payload": {"modal_page": {"widget_list": [
                    {"widget_type": "FEATURE_ROW", "data": {"title": "پارکینگ دارد"}}, {"widget_type": "FEATURE_ROW", "data": {"title": "بالكن دارد"}}, {"widget_type": "FEATURE_ROW", "data": {"title": "بالکن ندارد"}},
                    {"widget_type": "FEATURE_ROW", "data": {"title": "سونا", "disabled": True}}, {"widget_type": "FEATURE_ROW", "data": {"title": "سرمایش کولر آبی"}}, {"widget_type": "FEATURE_ROW", "data": {}},
                    {"widget_type": "WRAPPER_ROW", "data": {"chip_list": {"chips": [{"text": "بی‌برچسب"}]}}},
                    {"widget_type": "DESCRIPTION_ROW", "data": {"text": "مناسب برای"}}, {"widget_type": "WRAPPER_ROW", "data": {"chip_list": {"chips": [{"text": "خانواده"}, {"text": " "}, {"text": "مجرد"}, {"text": "خانواده"}]}}},
                    {"widget_type": "DESCRIPTION_ROW", "data": {"text": "دیگر"}}, {"widget_type": "WRAPPER_ROW", "data": {"chip_list": {"chips": [{"text": "کابینت"}]}}},
                ]}}},
            }},
        ]},
        {"section_name": "IMAGE", "widgets": [{"widget_type": "IMAGE_CAROUSEL", "data": {"items": [{"image": {"url": "u1"}}, {"image_url": "u2"}, {"image": {"url": ""}}]}}, {"widget_type": "IMAGE_SLIDER_ROW", "data": {"items": [{"image_url": "u3"}]}}]},
        {"section_name": "MAP", "widgets": [{"widget_type": "MAP_ROW", "data": {"location": {"fuzzy_data": {"point": {"latitude": 35.7, "longitude": 51.4}, "radius": 500}}}}]},
    ],
    "webengage": {"credit": 1, "rent": 2, "district": "d7", "cat_3": "suite", "business_type": "personal", "image_count": 4},
    "seo": {"web_info": {"title": "دیگر", "district_persian": "محله ۷", "city_persian": "تهران"}, "unavailable_after": "2030"},
}
BARE = {
    "sections": [
        {"widgets": [{"widget_type": "LEGEND_TITLE_ROW", "data": {"title": "not in the title section"}}, {"widget_type": "FEATURE_ROW", "data": {"title": "قابل تبدیل"}}]},
        {"section_name": "MAP", "widgets": [{"widget_type": "MAP_ROW", "data": {"location": {"exact_data": {"point": {"latitude": 35, "longitude": 51}}}}}]},
        {"section_name": "X"},
        {"section_name": "LIST_DATA", "widgets": [{"widget_type": "UNEXPANDABLE_ROW", "data": {"title": "تعداد کل طبقات ساختمان", "value": "۵"}}, {}, {"widget_type": "UNEXPANDABLE_ROW", "data": {"title": "طبقه", "value": "همکف"}}]},
    ],
    "webengage": {"credit": "۷۰۰٬۰۰۰", "rent": 10000.9}, "seo": {"web_info": {"title": "از پیوند"}},
}


def table(spark):
    rows = [("full", json.dumps(FULL, ensure_ascii=False)), ("bare", json.dumps(BARE)), ("cut", json.dumps(FULL)[:200]), ("null", None), ("empty", "{}"), ("odd", '{"sections": {"a": 1}, "webengage": 3}')]
    return posts.parsed(spark.createDataFrame(rows, "token string, raw string"))


def test_extract(spark):
    got = {r["token"]: r.asDict() for r in posts.extract(table(spark)).collect()}
    assert set(got) == {"full", "bare", "empty", "odd"}
    full = {
        "token": "full", "title": "آپارتمان 85 متری", "description": "خوش‌نقشه\nبا ۲ پارکینگ", "deposit": 200_000_000, "rent": 5_000_000, "effective_monthly_cost": 11_000_000, "can_convert": True, "convertible_deposit_max": 300_000_000,
        "is_full_deposit": False, "area_sqm": 85, "rooms": 2, "build_year": 1370, "build_year_text": "قبل از 1370", "build_year_is_upper_bound": True, "floor": 2, "total_floors": 3,
        "has_elevator": False, "has_parking": False, "has_storage": True, "has_balcony": True, "lat": 35.7, "lon": 51.4, "location_precision": "FUZZY", "location_radius_meters": 500.0, "neighborhood": "محله 7", "neighborhood_slug": "d7",
        "city": "تهران", "location_text": "محله 7", "category": "suite", "business_type": "personal", "published_text": "زمان انتشار 2 ساعت پیش", "unavailable_after": "2030", "image_count": 4, "images": ["u1", "u2", "u3"],
        "attributes": {"طبقه": "2 از 3", "سند": "تک‌برگ"}, "other_features": ["سرمایش کولر آبی", "نورگیر"], "suitable_for": ["خانواده", "مجرد"],
    }
    assert got["full"] == full
    bare = {k: got["bare"][k] for k in ("title", "description", "deposit", "rent", "can_convert", "is_full_deposit", "floor", "total_floors", "has_elevator", "lat", "location_precision", "location_radius_meters", "images", "category")}
    assert bare == {"title": "از پیوند", "description": "", "deposit": 700_000, "rent": 10_000, "can_convert": True, "is_full_deposit": True, "floor": None, "total_floors": 5, "has_elevator": None, "lat": 35.0, "location_precision": "EXACT", "location_radius_meters": None, "images": [], "category": posts.DEFAULT_CATEGORY}
    assert got["empty"]["title"] == "" and got["empty"]["deposit"] is None and got["empty"]["images"] == [] and not got["empty"]["can_convert"]


def test_widgets_and_chips(spark):
    rows = [(r["section"], r["widget_type"], r["branch"], r["sub_pos"]) for r in posts.widgets(table(spark)).filter("token = 'full'").orderBy("section_pos", "widget_pos", "branch", "sub_pos").collect()]
    assert rows[:3] == [("TITLE", "LEGEND_TITLE_ROW", 0, 0), ("TITLE", "TITLE_ROW", 0, 0), ("DESCRIPTION", "DESCRIPTION_ROW", 0, 0)]
    assert ("LIST_DATA", "UNEXPANDABLE_ROW", 1, 0) in rows and sum(r[0] == "MODAL" for r in rows) == 11 and len(rows) == 25
    chips = table(spark).filter("token = 'full'").select(F.inline(posts.chips())).collect()
    assert [tuple(c) for c in chips] == [("", "بی‌برچسب"), ("مناسب برای", "خانواده"), ("مناسب برای", "مجرد"), ("مناسب برای", "خانواده"), ("دیگر", "کابینت")]


def test_nothing_is_shuffled(spark):
    plan = posts.extract(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_records(spark):
    """Fields with their origins, repairs and reasons, on adverts that leave most things out."""
    one = posts.extract(table(spark)).filter("token = 'full'")
    off = F.lit(None)
    rows = (
        one.withColumn("token", F.lit("plain"))
        .unionByName(one.withColumns({"token": F.lit("mined"), "area_sqm": F.lit(115115).cast("bigint"), "description": F.lit("۹۰ متر سه خواب بدون بالکن غیرقابل تبدیل در 6 طبقه"), "rooms": off.cast("bigint"), "has_balcony": off.cast("boolean"), "total_floors": off.cast("bigint"), "floor": off.cast("bigint"), "attributes": F.create_map().cast("map<string,string>"), "build_year": off.cast("bigint")}))
        .unionByName(one.withColumns({"token": F.lit("huge"), "area_sqm": F.lit(9000).cast("bigint"), "title": F.lit("خانه"), "deposit": F.lit(20_000_000_000), "rooms": off.cast("bigint"), "description": F.lit("ویلایی"), "floor": F.lit(60).cast("bigint")}))
        .unionByName(one.withColumns({"token": F.lit("")}))
        .unionByName(one.withColumns({"token": F.lit("bad")}))
        .unionByName(one.withColumns({"token": F.lit("sizeless"), "area_sqm": off.cast("bigint"), "title": F.lit(""), "description": F.lit("")}))
        .unionByName(one.withColumns({"token": F.lit("cheap"), "deposit": off.cast("bigint"), "rent": F.lit(1000).cast("bigint")}))
    )
    got = {r["token"]: r for r in records.resolve(rows, rejected=("bad",)).collect()}
    assert {t: r["reason"] for t, r in got.items()} == {"plain": None, "mined": None, "huge": None, "": "no_token", "bad": "manually_rejected", "sizeless": "no_area", "cheap": "placeholder_price"}
    plain, mined, huge = got["plain"], got["mined"], got["huge"]
    assert plain["provenance"] == {"deposit": "structured", "rent": "structured", "can_convert": "default", "area_sqm": "structured", "rooms": "structured", "floor": "attribute", "total_floors": "attribute", "build_year": "structured_upper_bound", "has_elevator": "structured", "has_parking": "structured", "has_storage": "structured", "has_balcony": "structured"}
    # The title says 85 metres before the description says 90.
    assert (mined["area_sqm"], mined["rooms"], mined["has_balcony"], mined["can_convert"], mined["floor"], mined["total_floors"], mined["quality_flags"]) == (85, 3, False, False, 0, 6, ["area_repaired_from_text"])
    assert [mined["provenance"][f] for f in ("area_sqm", "rooms", "has_balcony", "can_convert", "floor", "total_floors", "build_year")] == ["listing_text"] * 4 + ["default", "listing_text", "unknown"]
    assert (huge["area_sqm"], huge["rooms"], huge["floor"], huge["total_floors"], huge["quality_flags"]) == (2000, 5, 40, 40, ["area_implausible"])
    assert [huge["provenance"][f] for f in ("area_sqm", "rooms", "total_floors")] == ["structured_clamped", "estimated_from_area", "derived_from_floor"]
    nowhere = spark.createDataFrame([("plain", None, None, None, None, "none", None, None, None, None, None, None), ("mined", "a1", "Area", 35.7, 51.4, "neighborhood_centroid", None, "m", "M", 80.0, 1.0, False)], "token string, area_key string, area_title string, lat double, lon double, link_method string, district string, metro_id string, metro_name string, metro_meters double, metro_walk_mins double, in_zone boolean")
    whole = records.located(records.resolve(rows, rejected=("bad",)), nowhere)
    assert {r["token"]: r["reason"] for r in whole.filter("token IN ('plain', 'mined', 'huge')").collect()} == {"plain": "no_location", "mined": None, "huge": "no_location"}
    record = records.nested(whole, url="https://example.org/").collect()[0]
    assert record["id"] == "crawl-mined" and record["location"]["precision"] == "FUZZY" and record["quality_flags"][-1] == "position_is_neighborhood_centroid" and record["provenance"]["lat"] == "neighborhood_centroid"
    assert record["media"]["images"] == ["u1", "u2", "u3"] and record["source"]["url"] == "https://example.org/mined" and record["features"] == {"cooling": ["کولر آبی"]}
    summary = {r["measure"]: r["n"] for r in records.summary(whole).collect()}
    assert summary["raw"] == 7 and summary["kept"] == 1 and summary["dropped:no_location"] == 2 and summary["rooms:listing_text"] == 1 and summary["flag:area_repaired_from_text"] == 1


def test_posts_lie_packed(spark, sf):
    """Raw posts are many times larger than the table that they are made from; what lies on disk is not."""
    rows = plans.raw_posts(spark, sf)
    stored = sum(os.path.getsize(urlsplit(f).path) for f in rows.inputFiles())
    assert 10 * stored < rows.agg(F.sum(F.octet_length("raw"))).first()[0]


def test_posts_are_written_by_many_tasks(spark, sf):
    from homerank.plans.posts import raw_posts

    names = raw_posts(spark, sf).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r["f"].rsplit("part-", 1)[1][:5] for r in names}) > 1


def test_a_text_is_brought_to_plain_form_once(spark):
    """What a lambda says twice, Spark computes twice: titles of features were folded eight times each."""
    plan = table(spark).select(posts.features().alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 2


def test_records_are_settled_where_posts_are_read(spark, sf):
    """Whole posts are not dealt anew to learn where they stand."""
    plan = plans._whole(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(token" not in plan
