"""Rules on single rows, and what SQL does not express."""

import numpy as np
from pyspark.sql import functions as F

from homerank.functions import money, text
from homerank.operators import corpus, iterate, market, pareto, quality, search, textsearch
from homerank.streaming import feeds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_money(spark):
    for deposit, rent, cost in ((100_000_000, 0, 3_000_000), (0, 15_000_000, 15_000_000), (200_000_000, 10_000_000, 16_000_000)):
        assert one(spark, money.tmc(F.lit(deposit), F.lit(rent))) == cost
    assert one(spark, money.fde(F.lit(0), F.lit(3_000_000))) == 100_000_000


def test_split_moves_only_for_a_reason(spark):
    args = [F.lit(x) for x in (300_000_000, 0, True)]
    d, r = money.resolve_split(*args, F.lit(None).cast("bigint"), F.lit(100_000_000), F.lit("balanced"))
    assert (one(spark, d), one(spark, r)) == (100_000_000, 6_000_000)
    d, r = money.resolve_split(*args, F.lit(None).cast("bigint"), F.lit(0), F.lit("balanced"))
    assert (one(spark, d), one(spark, r)) == (300_000_000, 0)


def test_text_rules(spark):
    assert one(spark, text.normalize(F.lit("  سعادت اباد  "))) == "سعادت آباد"
    assert one(spark, text.is_shared_living(F.lit("اجاره اتاق"), F.lit(None).cast("string")))
    assert one(spark, text.is_parking_rental(F.lit("پارکینگ مسقف")))
    assert not one(spark, text.is_parking_rental(F.lit("پارکینگ اصلی ۶۴ متر طبقه دوم")))
    assert one(spark, text.mine_total_floors(F.lit("در 6 طبقه"))) == 6
    assert one(spark, text.mine_area(text.prepared(F.lit("۱۱۵۱۱۵ متر و ۹۰ متر")))) == 90
    assert one(spark, text.first_integer(F.lit("۲ از ۳"))) == 23


def test_skyline_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(s), i, int(a), float(b), int(c)) for i, (s, a, b, c) in enumerate(rng.integers(0, 12, (400, 4)))]
    df = spark.createDataFrame(rows, "search_id int, id int, cost bigint, metro_walk_mins double, area_sqm int")
    got = {r["id"] for r in pareto.pareto(df).filter("is_pareto").collect()}
    beats = lambda p, q: p[0] == q[0] and p[2] <= q[2] and p[3] <= q[3] and p[4] >= q[4] and (p[2], p[3], p[4]) != (q[2], q[3], q[4])
    assert got == {q[1] for q in rows if not any(beats(p, q) for p in rows)}


def test_upsert(spark):
    schema = "id string, fingerprint string, ingest_seq int"
    stored = spark.createDataFrame([("a", "f1", 1), ("b", "f2", 2)], schema)
    batch = spark.createDataFrame([("c", "f1", 3), ("a", "f9", 4), ("d", "f3", 5), ("e", "f3", 6), ("b", "f1", 7)], schema)
    got = {(r["id"], r["fingerprint"], r["action"]) for r in corpus.upsert(stored, batch).collect()}
    assert got == {("a", "f9", "updated"), ("b", "f2", "kept"), ("d", "f3", "inserted")}


def test_quota_sample(spark):
    posts = spark.range(100).select(F.col("id").alias("token"), (F.col("id") % 3).alias("shard"))
    got = market.quota_sample(posts, posts.filter("token < 30").select("token"), 5, "token", "shard").collect()
    assert len(got) == 15 and all(r["token"] >= 30 for r in got)


def test_rank_is_a_permutation_of_the_kept(spark, sf):
    from homerank.plans import searches

    rows = searches.ranked(spark, sf).groupBy("search_id").agg(F.max("rank").alias("m"), F.count_distinct("rank").alias("n")).collect()
    assert rows and all(r["m"] == r["n"] for r in rows)
    assert search.page(searches.ranked(spark, sf), 2, 5).filter("search_id = 2").count() == 5


def test_whole_rankings(spark):
    """Ranks by bins of score are those of one sort, with ties, rounding to nine places and any number of bins."""
    rng = np.random.default_rng(4)
    rows = [(int(s), f"i{i}", float(x)) for i, (s, x) in enumerate(zip(rng.integers(0, 3, 3000), np.round(rng.uniform(0.45, 1.0, 3000), 3) + rng.choice([0, 1e-12], 3000)))] + [(7, f"t{i}", 1.0) for i in range(50)] + [(8, "only", 0.45)]
    df = spark.createDataFrame(rows, "search_id int, id string, score double")
    want = {}
    for s in {r[0] for r in rows}:
        for rank, (_, i, _) in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: (-round(r[2], 9), r[1])), 1):
            want[s, i] = rank
    for bins in (1, 7, 1 << 14):
        assert {(r["search_id"], r["id"]): r["rank"] for r in search.rank_all(df, bins).collect()} == want
    assert search.rank_all(df.limit(0)).count() == 0


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.unionByName(events.limit(50)).repartition(2).write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = feeds.seen_tokens(feed).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == events.count()
    q = feeds.hourly_rate(feed).writeStream.outputMode("complete").format("memory").queryName("rate").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rate").agg(F.sum("posts")).first()[0] == events.count() + 50


def test_quotas_hold_their_limits_and_target(spark):
    """Between the limits, shares follow the rates; what the upper limit cuts off goes to the others."""
    for target in (300, 3000, 9000):
        rates = [(i, 1.0 * (i + 1) ** 2) for i in range(30)]
        got = {r["shard"]: r["quota"] for r in quality.allocate_quotas(spark.range(34).withColumnRenamed("id", "shard"), spark.createDataFrame(rates, "shard bigint, rate double"), target).collect()}
        assert len(got) == 34 and all(8 <= q <= 400 for q in got.values())
        free = sorted((i, q) for i, q in got.items() if 8 < q < 400 and i < 30)
        assert all(a[1] <= b[1] for a, b in zip(free, free[1:]))
        if target == 3000:
            assert abs(sum(got.values()) - target) < 0.1 * target


def test_components_of_a_chain_and_loose_ends(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(3, 1), (5, 5)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in iterate.components(spark.range(45), links).collect()}
    assert got == {i: 10 if 10 <= i <= 40 else 1 if i in (1, 3) else i for i in range(45)}


def test_text_search_wants_all_terms_and_handles_nothing(spark):
    texts = spark.createDataFrame([(1, "red house red"), (2, "Red garden"), (3, None), (4, "")], "id int, text string")
    asked = spark.createDataFrame([(1, "red"), (2, "red house"), (3, ""), (4, None), (5, "missing")], "query_id int, text string")
    got = {(r["query_id"], r["id"]) for r in textsearch.search(texts, asked).collect()}
    assert got == {(1, 1), (1, 2), (2, 1)}


def test_upsert_counts(spark):
    schema = "id string, fingerprint string, ingest_seq int"
    stored = spark.createDataFrame([("a", "f1", 1), ("b", "f2", 2)], schema)
    batch = spark.createDataFrame([("c", "f1", 3), ("a", "f9", 4), ("d", "f3", 5), ("e", "f3", 6)], schema)
    got = corpus.upsert_counts(corpus.upsert(stored, batch), batch).first()
    assert tuple(got) == (1, 1, 2, 3)


def test_slips_of_the_pen(spark):
    """The likest place by difflib's ratio, every pair compared."""
    from difflib import SequenceMatcher

    from homerank.operators import names

    rng = np.random.default_rng(6)
    places = ["".join(rng.choice(list("abcdef"), n)) for n in rng.integers(3, 12, 60)]
    asked = [p[: len(p) // 2] + rng.choice(list("abcx")) + p[len(p) // 2 + int(rng.integers(0, 2)) :] for p in places] + ["abc", ""]
    rows = spark.createDataFrame([(a, a) for a in set(asked)], "name string, __needle string")
    got = {r["name"]: r["__like"] for r in names.fuzzy(rows, spark.createDataFrame([(p,) for p in set(places)], "form string"), "name").collect()}
    want = {}
    for a in set(asked):
        best = min(((-SequenceMatcher(None, a, p).ratio(), p) for p in set(places) if abs(len(a) - len(p)) <= 3), default=(0, ""))
        if len(a) >= 4 and -best[0] > 0.85:
            want[a] = best[1]
    assert got == want and want


def test_medians_with_hot_groups_ties_and_nulls(spark):
    rng = np.random.default_rng(8)
    rows = [("hot", 5.0)] * 3000 + [("hot", float(x)) for x in rng.normal(5, 1, 2000)] + [("even", 1.0), ("even", 2.0), ("one", 7.0), ("none", None), (None, 3.0)] + [("wide", float(x)) for x in rng.permutation(30_001)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: (r["median"], r["n"]) for r in market.medians(df, ["k"], "x").collect()}
    want = {k: float(np.median([x for a, x in rows if a == k])) for k in ("hot", "even", "one", "wide", None)}
    assert {k: m for k, (m, _) in got.items()} == want
    assert market.medians(df, [], "x").first()["median"] == float(np.median([x for _, x in rows if x is not None]))
    for whole in (0, 10**6):  # by sketches, and group by group
        got = {r["k"]: r["median"] for r in market.medians(df, ["k"], "x", whole).collect()}
        assert got == want and market.medians(df, [], "x", whole).first()["n"] == sum(x is not None for _, x in rows)


def test_backfill_twice_changes_nothing(spark):
    rows = spark.createDataFrame([(1, False), (2, True), (3, False)], "k int, flag boolean")
    once, stamp = corpus.backfill(rows, "1", "2", "flag", F.lit(True), F.col("k") == 3)
    twice, _ = corpus.backfill(once, stamp, "2", "flag", F.lit(True), F.lit(True))
    assert [r["flag"] for r in twice.orderBy("k").collect()] == [False, True, True]
    assert [r["flag"] for r in corpus.backfill(rows.drop("flag"), None, "2", "flag", F.col("k") == 1, F.lit(False))[0].orderBy("k").collect()] == [True, False, False]


def test_many_searches_meet_the_same_homes(spark, sf, monkeypatch):
    """The way of bins gives the pairs of the way that sends the searches to every task."""
    from homerank.plans import searches

    pairs = lambda: {(r["search_id"], r["id"]) for r in search.candidates(searches.market_of(spark, sf), searches.saved_searches(spark, sf)).filter(search.hard_mask_without_split()).select("search_id", "id").collect()}
    few = pairs()
    monkeypatch.setattr(search, "FEW_INTENTS", 0)
    assert few and pairs() == few


def test_name_lists_meet_as_in_plain_python(spark):
    """Exact, contained, alike and by subtitle, and what several claim; against difflib name by name."""
    import difflib
    import random
    import re
    from collections import defaultdict

    from homerank.operators import names

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    polygons = [(i, word(rng.randint(2, 9))) for i in range(250)] + [(300, "Kuh (x)"), (301, "kuh-sar"), (302, "")]
    items = []
    for i in range(300):
        base = rng.choice(polygons)[1]
        title = rng.choice([base, base + " " + word(2), word(6), base[: len(base) // 2] + "z" + base[len(base) // 2 :], "محله " + base, "", None, base[:4]])
        items.append((i, title, rng.choice([None, "", "by " + rng.choice(polygons)[1]])))

    def bare(text):
        text = re.sub(r"\(.*?\)", "", (text or "").replace("ي", "ی").replace("ك", "ک").replace("ة", "ه").replace("\u200c", " "))
        return " ".join(re.sub(r"\b(محله|منطقه|خیابان|شهرک)\b", "", re.sub(r"[^\w\s]", " ", text)).split())

    forms = {}
    for _, name in polygons:
        if bare(name):
            forms[bare(name)] = name
    claims = defaultdict(list)
    for i, title, subtitle in items:
        t, s = bare(title), bare(subtitle)
        found = (t, "exact") if t in forms else None
        found = found or next(((f, "part") for f in forms if len(f) > 3 and f in t or len(t) > 3 and t in f), None)
        found = found or next(((f, "like") for f in difflib.get_close_matches(t, list(forms), n=1, cutoff=0.80)), None)
        found = found or next(((f, "subtitle") for f in forms if len(f) > 3 and f in s), None)
        if found:
            claims[forms[found[0]]].append((i, found[1]))
    want = {}
    for name, own in claims.items():
        exact = [c for c in own if c[1] == "exact"]
        for i, step in own if len(own) == 1 else exact if len(exact) == 1 else []:
            want[i] = (name, step)
    out = names.match_name_list(spark.createDataFrame(items, "id int, title string, subtitle string"), spark.createDataFrame(polygons, "ord int, name string")).collect()
    assert len(out) == len(items) and {r["id"]: (r["polygon"], r["step"]) for r in out if r["polygon"] is not None} == want
    assert len({step for _, step in want.values()}) == 4


def test_same_name_places_that_cross_or_lie_apart(spark):
    from homerank.operators import spatial

    def box(i, name, lat0, lat1, lon0, lon1):
        return i, name, lat0, lat1, lon0, lon1, [(lat0, lon0), (lat0, lon1), (lat1, lon1), (lat1, lon0)]

    rows = [box(1, "a", 35.60, 35.70, 51.30, 51.31), box(2, "a", 35.65, 35.66, 51.20, 51.40), box(3, "a", 35.6605, 35.67, 51.39, 51.40), box(4, "b", 35.65, 35.66, 51.20, 51.40), box(5, "a", 35.80, 35.81, 51.2, 51.21), box(6, "a", 35.802, 35.803, 51.202, 51.203)]
    df = spark.createDataFrame(rows, "id int, name string, min_lat double, max_lat double, min_lon double, max_lon double, ring array<struct<lat: double, lon: double>>")
    assert {r["id"]: r["place"] for r in spatial.same_name_places(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    assert spatial.same_name_places(df.limit(0)).count() == 0


def test_hash_embedding_of_awkward_texts(spark):
    from homerank.operators import names

    rows = [(1, None), (2, ""), (3, "a ! b"), (4, "Two two TWO words"), (None, "two")]
    got = {r["k"]: r["vector"] for r in names.hash_embedding(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert got[1] == got[2] == got[3] == {} and len(got) == 5
    for vector in (got[4], got[None]):
        assert abs(sum(w * w for w in vector.values()) - 1) < 1e-9
    assert sorted(got[4].values()) == [1 / np.sqrt(10), 3 / np.sqrt(10)] or np.allclose(sorted(got[4].values()), [1 / np.sqrt(10), 3 / np.sqrt(10)])
