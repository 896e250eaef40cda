"""Names against brute force: containment, landmarks, the linking cascade, keywords of areas."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from homerank.operators import keywords, names


def test_containment_equals_brute_force(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abAب") for _ in range(n))
    inner, outer = [word(rnd.randint(1, 6)) for _ in range(150)] + ["", None], [word(rnd.randint(0, 12)) for _ in range(150)] + [None]
    got = names.contained(spark.createDataFrame([(x,) for x in inner], "inner string"), spark.createDataFrame([(x,) for x in outer], "outer string"), 1)
    assert {tuple(r) for r in got.collect()} == {(a, b) for a in inner for b in outer if a and b is not None and a in b} and got.count() == got.distinct().count()


def test_alike_names_meet_by_what_is_left_of_both(spark):
    """Many names of one length meet by shortened texts, few of a length one by one; both lose no pair that a ratio leaves."""
    rnd = random.Random(5)
    forms = ["".join(rnd.choice("abcdef") for _ in range(10)) for _ in range(400)] + ["ab", "a", "abcdefghijklmnopqrstuvwxyz" * 2, "\U0001f600bcde"]
    slip = lambda x: x[: (i := rnd.randrange(len(x)))] + rnd.choice(["", "q", "qx"]) + x[i + rnd.randint(0, 2) :]
    titles = sorted({slip(slip(x)) for x in forms} | {"a", "b", "abcdefghijklmnopqrstuvwxyz" * 2} - {""})
    made = names.alike_pairs(spark.createDataFrame([(t,) for t in titles], "t string"), spark.createDataFrame([(f,) for f in forms], "form string"))
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(set(got)) < len(titles) * len(forms) / 20
    assert {(t, f) for t in titles for f in forms if SequenceMatcher(None, f, t).ratio() >= names.PAIRED} <= set(got)
    assert sorted(r[0] for r in spark.createDataFrame([("abcd",)], "x string").select(F.explode(names._shortened(F.col("x"), F.lit(2)))).collect()) == sorted(r[0] for r in spark.createDataFrame([(x,) for x in ("ab", "ac", "ad", "bc", "bd", "cd")], "x string").select(F.xxhash64("x")).collect())


def test_no_product_of_names(spark):
    """With broadcasts off, names still meet by equality."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        areas = spark.createDataFrame([("a", 0, "Hill", 1, ["Road"])], "area_key string, ord int, title string, size int, keywords array<string>")
        asked = spark.createDataFrame([("the hill side",)], "name string")
        shards = spark.createDataFrame([(1, "s", "t", "name")], "shard int, slug string, second_slug string, name string")
        for made in (names.resolve_title(asked, areas), names.resolve_keyword(asked, areas), names.resolve_shards(asked.withColumnRenamed("name", "selector"), shards)):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_landmark_steps(spark):
    stations = spark.createDataFrame([("میدان انقلاب اسلامی", 35.70, 51.39, "brt"), ("میدان انقلاب اسلامي", 35.72, 51.41, "metro"), ("تئاتر شهر", 35.7, 51.4, "metro"), ("شهدا", 35.1, 51.1, "metro"), ("میدان شهدا", 35.2, 51.2, "metro"), ("هفده شهدا", 35.3, 51.3, "metro")], "name string, lat double, lon double, type string")
    curated = spark.createDataFrame([("دانشگاه صنعتی شریف", 35.705, 51.35, ["پلی تکنیک شریف"]), ("تئاتر شهر", 0.0, 0.0, ["تیاتر بزرگ"])], "name string, lat double, lon double, aliases array<string>")
    places = names.gazetteer(stations, curated)
    rows = {r["name"]: r for r in places.collect()}
    assert abs(rows["تئاتر شهر"]["lat"] - 35.7) < 1e-9 and rows["تئاتر شهر"]["kind"] == "metro" and len(rows) == 6 - 1 + 1
    asked = ["تئاتر شهر", "تئاترشهر", "تیاتر بزرگ", "پلی‌تکنیک شریف", "انقلاب", "خیابان انقلاب", "نزدیک صنعتی", "دم شریف خوب", "تاترشهر", "شهدا", "میدان هفده", "", None, "چیزی دیگر"]
    got = {r["name"]: (r["form"], r["step"]) for r in names.resolve_landmark(spark.createDataFrame([(a,) for a in asked], "name string"), places).collect()}
    theatre, revolution, sharif = "تیاترشهر", "میدانانقلاباسلامی", "دانشگاهصنعتیشریف"
    assert got["تئاتر شهر"] == (theatre, "whole") == got["تئاترشهر"] and got["تیاتر بزرگ"] == (theatre, "alias")
    assert got["پلی‌تکنیک شریف"] == (sharif, "alias") and got["انقلاب"] == (revolution, "bare") == got["خیابان انقلاب"]
    assert got["نزدیک صنعتی"] == (sharif, "word") == got["دم شریف خوب"] and got["تاترشهر"] == (theatre, "like")
    assert got["شهدا"] == ("شهدا", "whole") and got["میدان هفده"][1] == "word" and not {"", None, "چیزی دیگر"} & set(got)


def test_link_cascade(spark):
    areas = spark.createDataFrame([("a", 0, "Hill", 1, 35.6, 51.2, ["Old Road"]), ("b", 1, "Lake", 1, 35.8, 51.5, None)], "area_key string, ord int, title string, size int, center_lat double, center_lon double, keywords array<string>")
    rows = [(1, "Hill Side", 35.61, 51.21, "a"), (2, "Hill Side", 35.9, 51.9, None), (3, " Hill Side ", None, None, None), (4, "far", 35.79, 51.49, None), (5, None, None, None, None), (6, "Lake", None, None, None), (7, "Nowhere", None, None, None), (8, "far", None, None, None), (9, "old road", 35.6, 51.2, "a")]
    adverts = spark.createDataFrame(rows, "id int, name string, lat double, lon double, contained string")
    resolved = names.resolve_title(adverts.select(F.trim("name").alias("name")).filter("name <> ''"), areas).select("name", "area_key", F.lit(1).alias("rank"))
    votes = names.name_vote(adverts.withColumnRenamed("contained", "area_key"), resolved, areas)
    assert {r["name"]: (r["area_key"], r["how"]) for r in votes.collect()} == {"Hill Side": ("a", "points"), "old road": ("a", "points"), "Lake": ("b", "name"), "far": ("b", "mean_point")}
    near = spark.createDataFrame([(2, "b"), (4, "b")], "id int, area_key string")
    got = {r["id"]: (r["area_key"], r["lat"], r["lon"], r["link_method"]) for r in names.link_area(adverts, votes, near, areas, resolved).collect()}
    assert got[1] == ("a", 35.61, 51.21, "point_in_polygon") and got[2] == ("a", 35.85, 51.6, "name_vote") and got[3] == ("a", 35.6, 51.2, "neighborhood_centroid")
    assert got[4] == ("b", 35.79, 51.49, "name_vote") and got[5] == (None, None, None, None) == got[7] and got[6] == ("b", 35.8, 51.5, "neighborhood_centroid") == got[8]
    stored = spark.createDataFrame([("b", "Pond")], "area_key string, name string")
    aliases = {r["area_key"]: r["aliases"] for r in names.alias_union(votes, areas, stored).collect()}
    assert aliases == {"a": ["Hill Side", "old road"], "b": ["Pond", "far"]}


def test_clean_names(spark):
    rows = [("بزرگراه شهید همت", "همت"), ("بلوار شهید", "شهید"), ("خیابان  خیابان پل چوبی", "چوبی"), ("ناحیه ۵", None), ("Main Street", None), ("خ. ولی‌عصر", "ولی عصر"), ("ري", None), (None, None), ("", None), ("منطقه آزاد", "منطقه آزاد")]
    table = spark.createDataFrame(rows, "name string, want string")
    assert [(r["name"], r["x"]) for r in table.select("name", keywords.clean_name(F.col("name")).alias("x")).collect()] == rows


def test_keywords_of_areas(spark):
    tags = {"p": {"place": "x"}, "r": {"highway": "x"}, "t": {"railway": "station"}, "l": {}}
    things = [("a", i, f"راه {i}", tags["r"]) for i in range(9)] + [("a", 20 + i, "پارک لاله" if i == 0 else f"محل {i}", tags["p"]) for i in range(6)] + [("a", 40, "خیابان راه ۱", tags["t"]), ("a", 41, "راه 1", tags["t"]), ("a", 42, "محل1", tags["l"]), ("a", 43, "محل 1", tags["l"]), (None, 1, "گم", tags["p"]), ("c", 1, "پارک", tags["p"])]
    rows = spark.createDataFrame(things, "area_key string, pos int, name string, tags map<string,string>")
    areas = spark.createDataFrame([("a", None, "d1"), ("b", "کوهسار", "d1"), ("d", "کوهسار", None), ("e", "حکمت-دزاشیب", "d2"), ("c", " ", "d1")], "area_key string, title string, district string")
    got = {r["area_key"]: (r["title"], r["keywords"]) for r in keywords.poi_keywords(areas, rows).collect()}
    assert set(got) == {"a", "b", "d", "e"}  # nothing in c can be its title
    assert got["a"] == ("محل 1", ["پارک لاله", "محل 2", "محل 3", "راه 0", "راه 1", "راه 2", "راه 3", "راه 4", "راه 5", "راه ۱"])
    assert got["b"] == ("کوهسار (d1)", ["کوهسار"]) and got["d"] == ("کوهسار", []) and got["e"] == ("حکمت-دزاشیب", ["دزاشیب", "حکمت"])
    plan = keywords.area_names(rows)[0]._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # tasks pass on no more of an area than is taken


def test_slips_equal_brute_force_and_meet_few_names(spark):
    """Names with edits of all kinds against all places; most pairs of one length never meet."""
    rnd = random.Random(3)
    places = ["".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(4, 18))) for _ in range(150)]

    def slip(x):
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randrange(len(x))
            x = rnd.choice([x[:i] + x[i + 1 :], x[:i] + "z" + x[i:], x[:i] + "z" + x[i + 1 :]]) or "z"
        return x

    asked = sorted({slip(p) for p in places for _ in range(3)})
    frame, forms = spark.createDataFrame([(a, a) for a in asked], "name string, __needle string"), spark.createDataFrame([(p,) for p in places], "form string")
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    want = {a: best[1] for a in asked if len(a) >= names.FUZZY_LENGTH and (best := min(((-ratio(a, p), p) for p in places if abs(len(a) - len(p)) <= names.FUZZY_DIFFERENCE), default=(0, "")))[0] < -names.FUZZY}
    assert {r["name"]: r["__like"] for r in names.fuzzy(frame, forms, "name").collect()} == want and len(want) > 100
    long = [a for a in asked if len(a) >= 12]
    met = names._alike(frame.filter(F.length("name") >= 12), forms).distinct().count()
    assert 3 * met < sum(abs(len(a) - len(p)) <= names.FUZZY_DIFFERENCE for a in long for p in places)
