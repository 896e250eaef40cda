"""Names of places against polygons, and where an advert belongs."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.repair import clamp
from ..functions.text import match_form, squash_form
from .iterate import cut
from .spatial import areas_near, nearest_anchor

#: Tokens shorter than this identify nothing.
LEAST_TOKEN = 3


def unique_tokens(names: DataFrame, generic: tuple[str, ...] = ()) -> DataFrame:
    """token, id of names (id, name): words that exactly one place owns."""
    words = names.select("id", F.explode(F.split(F.lower("name"), "[ #]+")).alias("token")).filter((F.length("token") >= LEAST_TOKEN) & ~F.col("token").isin(*generic, ""))
    return words.groupBy("token").agg(F.min("id").alias("id"), F.max("id").alias("most")).filter("id = most").select("token", "id")


def name_vote(adverts: DataFrame, resolved: DataFrame | None = None, areas: DataFrame | None = None) -> DataFrame:
    """name, area_key, votes, how of adverts (name, area_key; with areas: lat, lon too): which area a name means.

    The area that most of a name's points fall in (the smaller key of equal ones; how: points); else, with `resolved` (name, area_key, rank),
    what the name itself means (name); else, with `areas`, that whose centre is nearest to the mean of its points (mean_point). Names are
    taken without white space at their ends, empty ones mean nothing. All sums are taken before they are sent.
    """
    rows = adverts.withColumn("name", F.trim("name")).filter("name <> ''")
    votes = rows.filter("area_key IS NOT NULL").groupBy("name", "area_key").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("name").agg(F.min_by(F.struct("area_key", "votes"), F.struct((-F.col("votes")).alias("v"), "area_key")).alias("b"))
    out = best.select("name", "b.area_key", "b.votes", F.lit("points").alias("how"))
    if resolved is not None:
        named = resolved.groupBy("name").agg(F.min_by("area_key", "rank").alias("area_key")).join(best.select("name"), "name", "left_anti")
        named = named.join(rows.select("name").distinct(), "name", "left_semi")
        out = cut(out.unionByName(named.select("name", "area_key", F.lit(0).cast("bigint").alias("votes"), F.lit("name").alias("how"))))
    if areas is not None:
        points = rows.filter("lat IS NOT NULL AND lon IS NOT NULL").groupBy("name").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).join(out.select("name"), "name", "left_anti")
        near = nearest_anchor(points, areas, id_col="name")
        out = out.unionByName(near.select("name", "area_key", F.lit(0).cast("bigint").alias("votes"), F.lit("mean_point").alias("how")))
    return out


def alias_union(votes: DataFrame, areas: DataFrame, stored: DataFrame) -> DataFrame:
    """area_key, aliases: voted names whose form is neither that of the area's title nor that of a keyword (areas: area_key, title, keywords),
    with the stored aliases (area_key, name), sorted."""
    words = F.concat(F.array("title"), F.coalesce("keywords", F.array().cast("array<string>")))
    known = areas.select("area_key", F.explode(words).alias("w")).select("area_key", squash_form(F.col("w")).alias("__form")).distinct()
    new = votes.select("area_key", "name", squash_form(F.col("name")).alias("__form")).join(areas.select("area_key"), "area_key", "left_semi").join(known, ["area_key", "__form"], "left_anti")
    return new.select("area_key", "name").union(stored.select("area_key", "name")).groupBy("area_key").agg(F.array_sort(F.collect_set("name")).alias("aliases"))


def clamped(lat: Column, lon: Column) -> tuple[Column, Column]:
    """A point within the city's box; null stays null."""
    return clamp(lat, C.CITY["min_lat"], C.CITY["max_lat"]), clamp(lon, C.CITY["min_lon"], C.CITY["max_lon"])


def link_area(rows: DataFrame, votes: DataFrame, anchors: DataFrame, centers: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """id, area_key, lat, lon, link_method of rows (id, name, lat, lon, contained), whose points are clamped to the city's box.

    The polygon around the point (point_in_polygon), else the area that the name means by vote (name_vote), else the nearest anchor
    (anchors: id, area_key; nearest_polygon); without a point the voted area, or what the name itself means (resolved), gives its centre
    (neighborhood_centroid); without any the row stays unlinked, with null for all four.
    """
    voted = votes.select("name", F.col("area_key").alias("__voted"))
    named = rows.withColumn("name", F.trim("name")).join(voted, "name", "left").join(anchors.select("id", F.col("area_key").alias("__near")), "id", "left")
    if resolved is None:
        named = named.withColumn("__own", F.lit(None).cast("string"))
    else:
        named = named.join(resolved.groupBy("name").agg(F.min_by("area_key", "rank").alias("__own")), "name", "left")
    seen = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    key = F.when(seen, F.coalesce("contained", "__voted", "__near")).otherwise(F.coalesce("__voted", "__own"))
    how = F.when(seen, F.when(F.col("contained").isNotNull(), "point_in_polygon").when(F.col("__voted").isNotNull(), "name_vote").when(F.col("__near").isNotNull(), "nearest_polygon"))
    how = how.when(~seen & key.isNotNull(), "neighborhood_centroid")
    linked = named.select("id", *[F.when(seen, c).alias(n) for c, n in zip(clamped(F.col("lat"), F.col("lon")), ("lat", "lon"))], key.alias("area_key"), how.alias("link_method"))
    linked = linked.join(centers.select("area_key", "center_lat", "center_lon"), "area_key", "left")
    return linked.select("id", "area_key", F.coalesce("lat", "center_lat").alias("lat"), F.coalesce("lon", "center_lon").alias("lon"), "link_method")


#: Shorter names never match by containment, nor shorter tokens by themselves.
LEAST_CONTAINED = 5
#: Likeness of a name to a place's that counts as a slip of the pen, the length from which it may, and by how much lengths may differ.
FUZZY, FUZZY_LENGTH, FUZZY_DIFFERENCE = 0.85, 4, 3


def _tokens(name: str) -> Column:
    """Squashed words of a name in order, those that are long enough."""
    return F.filter(F.transform(F.split(match_form(F.col(name)), " "), lambda w: F.replace(w, F.lit(" "), F.lit(""))), lambda w: F.length(w) >= LEAST_TOKEN)


#: Characters of the runs by which names find those that contain them.
GRAM = 3


def _grams(form: Column, sizes: tuple[int, ...]) -> Column:
    """Different runs of so many characters of a text; a shorter text has none of that size."""
    at = lambda q: F.when(F.length(form) >= q, F.transform(F.sequence(F.lit(1), F.greatest(F.length(form) - q + 1, F.lit(1))), lambda i: F.substring(form, i, q)))
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(at(q), F.array().cast("array<string>")) for q in sizes])))


def contained(inner: DataFrame, outer: DataFrame, least: int = GRAM) -> DataFrame:
    """inner, outer: pairs of different texts (inner: `inner`; outer: `outer`) of which the second contains the first, not empty.

    Each inner text looks for its rarest run of three characters (of all it has, one that the fewest outer texts have; a text of one or two
    characters for itself), so it meets few others by an equality join; `contains` then decides. least: the length of the shortest inner
    texts, if known. A run that every text has is looked for only by texts that have no other.
    """
    sizes = tuple(range(min(least, GRAM), GRAM + 1))
    outers = outer.select("outer").distinct().select("outer", F.explode(_grams(F.col("outer"), sizes)).alias("__gram"))
    counts = outers.groupBy("__gram").agg(F.count(F.lit(1)).alias("__n"))
    own = F.when(F.length("inner") >= GRAM, _grams(F.col("inner"), (GRAM,))).otherwise(F.array("inner"))
    inners = inner.select("inner").filter("inner <> ''").distinct().select("inner", F.explode(own).alias("__gram")).join(counts, "__gram", "left")
    # A run that no outer text has settles it: nothing is found by it.
    rarest = inners.groupBy("inner").agg(F.min_by("__gram", F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__gram")).alias("__gram"))
    return rarest.join(outers, "__gram").filter(F.col("outer").contains(F.col("inner"))).select("inner", "outer")


def _by_steps(asked: DataFrame, exact: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """name, area_key, step of asked names by an index (form, area_key, ord) of exact forms: the whole name, else its first word
    that is one, else the first form by ord that contains it or that it contains. Names without a match are left out.

    The index has a row for each form of an area; distinct names alone meet it, first by equality, and only the rest by containment, through the rarest run of characters.
    """
    forms = asked.select(name).distinct().withColumn("__needle", squash_form(F.col(name))).filter(F.col("__needle") != "")
    whole = exact.select(F.col("form").alias("__needle"), F.col("area_key").alias("__whole"))
    words = forms.select(name, F.posexplode(_tokens(name)).alias("__pos", "form")).filter(F.length(squash_form(F.col(name))) >= LEAST_TOKEN).join(exact.select("form", "area_key"), "form")
    words = words.groupBy(name).agg(F.min_by("area_key", "__pos").alias("__word"))
    found = forms.join(whole, "__needle", "left").join(words, name, "left")
    rest = found.filter("__whole IS NULL AND __word IS NULL").filter(F.length("__needle") >= LEAST_TOKEN).select(name, "__needle")
    forms = parts.filter(F.length("form") >= LEAST_CONTAINED).select("form", "area_key", "ord")
    needles = rest.select("__needle").distinct()
    around = contained(forms.select(F.col("form").alias("inner")), needles.select(F.col("__needle").alias("outer"))).select(F.col("inner").alias("form"), F.col("outer").alias("__needle"))
    within = contained(needles.select(F.col("__needle").alias("inner")), forms.select(F.col("form").alias("outer"))).select(F.col("outer").alias("form"), F.col("inner").alias("__needle"))
    best = around.unionByName(within).join(forms, "form").groupBy("__needle").agg(F.min_by("area_key", "ord").alias("__part"))
    inside = rest.join(best, "__needle").select(name, "__part")
    out = found.join(inside, name, "left").withColumn("area_key", F.coalesce("__whole", "__word", "__part"))
    step = F.when(F.col("__whole").isNotNull(), "whole").when(F.col("__word").isNotNull(), "word").otherwise("part")
    return out.filter("area_key IS NOT NULL").select(name, "area_key", step.alias("step"))


def resolve_title(asked: DataFrame, areas: DataFrame, name: str = "name") -> DataFrame:
    """name, area_key, step by the titles of areas (area_key, ord, title, size). The bare title of areas told apart by a qualifier in brackets means the largest of them."""
    titles = areas.select("area_key", "ord", "size", squash_form(F.col("title")).alias("form"), squash_form(F.regexp_replace("title", r"\s*\([^)]*\)\s*$", "")).alias("bare"))
    own = titles.groupBy("form").agg(F.max_by("area_key", "ord").alias("area_key"), F.max("ord").alias("ord"))
    bare = titles.filter("bare <> ''").groupBy(F.col("bare").alias("form")).agg(F.max_by("area_key", F.struct("size", "ord")).alias("area_key"), F.max("ord").alias("ord")).join(own.select("form"), "form", "left_anti")
    return _by_steps(asked, own.unionByName(bare), own, name)


def resolve_keyword(asked: DataFrame, areas: DataFrame, name: str = "name") -> DataFrame:
    """name, area_key, step by the keywords of areas (area_key, ord, keywords); of areas that share one the earliest has it."""
    each = areas.select("area_key", "ord", F.explode("keywords").alias("k")).select("area_key", "ord", squash_form(F.col("k")).alias("form")).filter("form <> ''")
    index = each.groupBy("form").agg(F.min_by("area_key", "ord").alias("area_key"), F.min("ord").alias("ord"))
    return _by_steps(asked, index, index, name)


#: Words that say what kind of place it is, and nothing else about it.
GENERIC = (
    "میدان", "میدون", "خیابان", "خ", "بلوار", "بزرگراه", "اتوبان", "کوچه", "پل", "سه راه", "سهراه", "چهارراه", "چهار راه", "مترو", "متروی", "ایستگاه", "پایانه", "ترمینال", "شهرک",
    "منطقه", "محله", "محدوده", "حوالی", "نزدیک", "اطراف", "دانشگاه", "دانشکده", "بیمارستان", "بوستان", "پارک", "برج", "مجتمع", "شرکت", "شهید", "امام", "اسلامی",
)


def gazetteer(stations: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """form, name, lat, lon, kind, ord, aliases: the places that names can mean.

    Stations (name, lat, lon, type) of one name are one place in their middle, a metro's if any is; curated places (name, lat, lon, aliases)
    come after them, and of places with one form the first counts."""
    none = F.array().cast("array<string>")
    own = stations.groupBy(squash_form(F.col("name")).alias("form")).agg(F.min("name").alias("name"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.max("type").alias("kind"))
    own = own.withColumns({"ord": F.lit(0), "aliases": none})
    if curated is None:
        return own
    more = curated.select(squash_form(F.col("name")).alias("form"), "name", "lat", "lon", F.lit("poi").alias("kind"), F.lit(1).alias("ord"), F.coalesce("aliases", none).alias("aliases"))
    # A curated entry of a station's very name gives that station its aliases.
    same = more.groupBy("name").agg(F.flatten(F.collect_list("aliases")).alias("__more"))
    whole = own.join(same, "name", "left").withColumn("aliases", F.coalesce("__more", none)).select(more.columns).unionByName(more)
    return whole.groupBy("form").agg(F.min_by(F.struct("name", "lat", "lon", "kind", "ord", "aliases"), F.struct("ord", "name")).alias("p")).select("form", "p.*")


def _bare_words(name: str, generic: tuple[str, ...]) -> Column:
    """Words of a name in order, but for those that say the kind of place."""
    return F.filter(F.split(match_form(F.col(name)), " "), lambda w: (w != "") & ~w.isin(*generic))


def resolve_landmark(asked: DataFrame, places: DataFrame, name: str = "name", generic: tuple[str, ...] = GENERIC) -> DataFrame:
    """name, form, step, lat, lon: the place that a name means, by the first step that finds one.

    The whole name, then the name without generic words, is looked up as a place's name, an alias, a place's name without generic words
    and a word that one place alone has; then each word of it, in order, as a name, an alias and such a word; then the likest spelling.
    One equality join with an index of all these forms finds the best of them. Names without a match, null and empty ones are left out.
    """
    words = lambda c: F.filter(_bare_words(c, generic), lambda w: F.length(w) >= LEAST_TOKEN)
    stripped = lambda c: F.array_join(_bare_words(c, generic), "")
    none = F.array().cast("array<string>")
    aliases = places.select("form", "ord", F.explode(F.coalesce("aliases", none) if "aliases" in places.columns else none).alias("a")) if "ord" in places.columns else None
    ranked = places if "ord" in places.columns else places.withColumn("ord", F.lit(0))
    rows = [ranked.select(F.col("form").alias("key"), F.lit(0).alias("kind"), "ord", "form"), ranked.select(stripped("name").alias("key"), F.lit(2).alias("kind"), "ord", "form")]
    if aliases is not None:
        rows.append(aliases.select(squash_form(F.col("a")).alias("key"), F.lit(1).alias("kind"), "ord", "form"))
    index = rows[0]
    for more in rows[1:]:
        index = index.unionByName(more)
    index = index.filter("key <> ''").groupBy("key", "kind").agg(F.min(F.struct("ord", "form")).getField("form").alias("form"))
    owners = ranked.select("form", F.explode(F.array_distinct(words("name"))).alias("key")).groupBy("key").agg(F.min("form").alias("form"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    index = index.unionByName(owners.select("key", F.lit(3).alias("kind"), "form"))
    forms = asked.select(name).distinct().withColumns({"__needle": squash_form(F.col(name)), "__bare": stripped(name)}).filter("__needle <> ''")
    probes = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.col("__needle").alias("key")), F.struct(F.lit(1).alias("at"), F.col("__bare").alias("key"))), F.transform(words(name), lambda w, i: F.struct((i + 2).alias("at"), w.alias("key"))))
    met = forms.select(name, F.inline(probes)).join(index, "key").filter("at < 2 OR kind <> 2")
    found = met.groupBy(name).agg(F.min_by(F.struct("form", "kind", "at"), F.struct("at", "kind")).alias("b"))
    step = F.when(F.col("b.at") > 1, "word").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("whole", "alias", "bare", "word")]), F.col("b.kind") + 1))
    found = cut(found.select(name, "b.form", step.alias("step")))
    rest = forms.join(found.select(name), name, "left_anti").select(name, F.coalesce(F.nullif("__bare", F.lit("")), "__needle").alias("__needle"))
    spelt = ranked.select("form", "ord", F.explode(F.array_distinct(F.array("form", stripped("name")))).alias("key")).filter("key <> ''")
    like = fuzzy(rest, spelt.select(F.col("key").alias("form")).distinct(), name).withColumnRenamed("__like", "key")
    like = like.join(spelt.groupBy("key").agg(F.min(F.struct("ord", "form")).getField("form").alias("form")), "key").select(name, "form", F.lit("like").alias("step"))
    return found.unionByName(like).join(places.select("form", "lat", "lon"), "form").select(name, "form", "step", "lat", "lon")


def _alike(asked: DataFrame, places: DataFrame) -> DataFrame:
    """asked (__needle) with `form` of places: all pairs that a ratio above FUZZY leaves, some of them several times, and few others.

    A name of which at most d characters are edited, cut into d + 1 pieces, has one of them unchanged, at most d characters off its place."""
    n = F.length("__needle")
    most = F.floor((1 - FUZZY) * (2 * n + FUZZY_DIFFERENCE) + 1e-9).cast("int")
    begin = lambda i: F.floor(i * n / (most + 1)).cast("int")
    piece = lambda i: F.struct(F.substring("__needle", begin(i) + 1, begin(i + 1) - begin(i)).alias("__piece"), begin(i).alias("__at"))
    cut_up = asked.withColumn("__most", most).select("*", F.inline(F.transform(F.sequence(F.lit(0), most), piece)))
    sizes = cut_up.select(F.length("__piece").alias("__size")).distinct()
    m = F.length("form")
    runs = F.broadcast(sizes).crossJoin(places.filter(m >= 1).distinct()).filter(F.col("__size") <= m)  # a row for each width of a piece, which are few
    at = F.sequence(F.lit(0), m - F.col("__size"))
    runs = runs.select("form", F.inline(F.transform(at, lambda i: F.struct(F.substring(F.col("form"), i + 1, F.col("__size")).alias("__piece"), i.alias("__stands")))))
    close = (F.abs(F.col("__at") - F.col("__stands")) <= F.col("__most")) & (F.abs(n - m) <= FUZZY_DIFFERENCE)
    return cut_up.join(runs, "__piece").filter(close).drop("__piece", "__at", "__stands", "__most")


def fuzzy(asked: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """name, __like: the likest place of names (name, __needle) by difflib's ratio, above FUZZY; the first form of equal ones.

    Names meet places by pieces of themselves; pairs too many edits apart for the ratio are dropped by Spark before Python sees them.
    """
    pairs = _alike(asked.filter(F.length("__needle") >= FUZZY_LENGTH).select(name, "__needle"), places.select("form"))
    # A ratio above r leaves at most (1 - r) of both lengths unmatched, and every edit leaves one unmatched at least.
    pairs = pairs.filter(F.levenshtein("__needle", "form") <= (1 - FUZZY) * (F.length("__needle") + F.length("form"))).select(name, "__needle", "form").distinct()

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["ratio"] = [SequenceMatcher(None, a, b).ratio() for a, b in zip(pdf["__needle"], pdf["form"])]
            yield pdf[[name, "form", "ratio"]]

    best = F.min_by("form", F.struct((-F.col("ratio")).alias("r"), "form"))
    return pairs.mapInPandas(ratios, f"{name} string, form string, ratio double").filter(F.col("ratio") > FUZZY).groupBy(name).agg(best.alias("__like"))


def resolve_areas(asked: DataFrame, areas: DataFrame, places: DataFrame, polygons: DataFrame) -> DataFrame:
    """name, rank, area_key of asked names: the area of that title; else the areas around the landmark of that name, nearest first;
    else the area with that keyword. A name that means nothing has no row; an area's own key means itself."""
    every = asked.select("name").filter("name IS NOT NULL").distinct()
    keys = every.join(areas.select(F.col("area_key").alias("name")), "name", "left_semi").select("name", F.lit(1).alias("rank"), F.col("name").alias("area_key"))
    named = every.join(keys.select("name"), "name", "left_anti")
    # Each step goes on with the names that the steps before left; their results are cut off, as each is read twice.
    title = cut(resolve_title(named, areas).select("name", F.lit(1).alias("rank"), "area_key"))
    rest = cut(named.join(title.select("name"), "name", "left_anti"))
    marks = cut(resolve_landmark(rest, places).select("name", "lat", "lon"))
    near = cut(areas_near(marks, polygons, id_col="name").select("name", "rank", "area_key"))
    rest = rest.join(near.select("name").distinct(), "name", "left_anti")
    return keys.unionByName(title).unionByName(near).unionByName(resolve_keyword(rest, areas).select("name", F.lit(1).alias("rank"), "area_key"))


def resolve_lists(asked: DataFrame, resolved: DataFrame) -> DataFrame:
    """request, area_keys of asked (request, pos, name): the areas of a request's names, each once, where it comes first."""
    first = asked.join(resolved, "name").groupBy("request", "area_key").agg(F.min(F.struct("pos", "rank")).alias("at"))
    keys = first.groupBy("request").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "area_key"))), lambda x: x.area_key).alias("area_keys"))
    return asked.select("request").distinct().join(keys, "request", "left").select("request", F.coalesce("area_keys", F.array().cast("array<string>")).alias("area_keys"))


#: Likeness that pairs a title with a polygon's name, and the length above which one may contain the other.
PAIRED, PAIRED_CONTAINED = 0.80, 3
#: Words that say what kind of place it is.
KIND_WORDS = "محله|منطقه|خیابان|شهرک"


def bare_name(text: Column) -> Column:
    """A name without brackets, signs and words for the kind of place."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "يكة\u200c", "یکه "), r"\(.*?\)", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\w\s]", " "), rf"(?U)\b({KIND_WORDS})\b", "")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def _lengths(names: DataFrame, name: str) -> DataFrame:
    """__size: the different lengths of names that one may contain."""
    return names.select(F.length(name).alias("__size")).distinct().filter(F.col("__size") > PAIRED_CONTAINED)


def _with_parts(names: DataFrame, name: str, sizes: DataFrame, part: str) -> DataFrame:
    """names, a row for each of their different substrings `part` that is as long as one of sizes (__size: lengths, which are few)."""
    n = F.length(name)
    wide = names.crossJoin(F.broadcast(sizes)).filter(F.col("__size") <= n)
    own = F.transform(F.sequence(F.lit(1), n - F.col("__size") + 1), lambda i: F.substring(F.col(name), i, F.col("__size")))
    return wide.withColumn(part, F.explode(F.array_distinct(own))).drop("__size")


def _shortened(form: Column, by: Column) -> Column:
    """Hashes of all texts that are left of a form when so many of its characters are taken out."""
    start = F.array(F.struct(form.alias("s"), F.lit(1).alias("at")))
    none = F.array().cast("array<struct<s:string,at:int>>")

    def without(a: Column) -> Column:
        each = F.transform(F.sequence(a["at"], F.greatest(F.length(a["s"]), a["at"])), lambda i: F.struct(F.concat(F.substring(a["s"], F.lit(1), i - 1), F.substring(a["s"], i + 1, F.length(a["s"]))).alias("s"), i.alias("at")))
        return F.when(a["at"] <= F.length(a["s"]), each).otherwise(none)

    left = F.aggregate(F.sequence(F.lit(0), by), start, lambda every, i: F.when(i == 0, every).otherwise(F.flatten(F.transform(every, without))))
    return F.array_distinct(F.transform(left, lambda a: F.xxhash64(a["s"])))


#: Blocks in which names of lengths that are compared one by one are dealt.
NAME_BLOCKS = 64


def alike_pairs(titles: DataFrame, forms: DataFrame) -> DataFrame:
    """t, form of titles (t) and forms (form), each once: all pairs that a ratio of PAIRED leaves, and few others.

    Of such a pair with lengths n and m at least PAIRED * (n + m) / 2 characters match in order, so both become one text of that length
    when what is over is taken out of each: an equality join on the hashes of all such texts. Where the names of two lengths are so few, or so
    long, that they have fewer pairs than such texts, they are compared one by one in blocks.
    """
    left = titles.select("t", F.length("t").alias("n")).filter("n > 0")
    right = forms.select("form", F.length("form").alias("m")).filter("m > 0")
    ways = lambda x: F.aggregate(F.sequence(F.lit(1), F.greatest(F.col(x) - F.col("same"), F.lit(1))), F.lit(1.0), lambda c, i: F.when(F.col(x) > F.col("same"), c * (F.col("same") + i) / i).otherwise(c))
    sizes = left.groupBy("n").agg(F.count(F.lit(1)).alias("titles")).crossJoin(F.broadcast(right.groupBy("m").agg(F.count(F.lit(1)).alias("forms"))))  # a row for each two lengths
    sizes = sizes.withColumn("same", F.ceil(PAIRED * (F.col("n") + F.col("m")) / 2 - 1e-9).cast("int")).filter(F.col("same") <= F.least("n", "m"))
    sizes = cut(sizes.select("n", "m", "same", (ways("n") * F.col("titles") + ways("m") * F.col("forms") < F.col("titles").cast("double") * F.col("forms")).alias("short")))
    by_text, one_by_one = F.broadcast(sizes.filter("short").drop("short")), F.broadcast(sizes.filter("NOT short").select("n", "m"))
    keys = lambda rows, name, size: rows.join(by_text, size).select(name, "n", "m", F.explode(_shortened(F.col(name), F.col(size) - F.col("same"))).alias("key"))
    met = keys(left, "t", "n").join(keys(right, "form", "m"), ["n", "m", "key"]).select("t", "form")
    blocks = F.explode(F.sequence(F.lit(0), F.lit(NAME_BLOCKS - 1)))
    asked = left.join(one_by_one, "n").withColumn("block", blocks)
    dealt = right.join(one_by_one.select("m").distinct(), "m").withColumn("block", F.pmod(F.xxhash64("form"), F.lit(NAME_BLOCKS)).cast("int"))
    every = met.unionByName(asked.join(dealt, ["m", "block"]).select("t", "form"))
    return every.filter(F.levenshtein("t", "form") <= (1 - PAIRED) * (F.length("t") + F.length("form")) + 1e-9).distinct()


def match_name_list(items: DataFrame, polygons: DataFrame) -> DataFrame:
    """id, polygon, step of items (id, title, subtitle) against polygons (ord, name): null and null where nothing is left.

    A title is a polygon's name; else contains one or is inside one, the first in order; else is like one; else the subtitle contains
    one. Of polygons with one bare name the last counts. A polygon that several items claim goes to the only one with its very name, else to none.
    Names meet by equality: through their substrings that are as long as some name, and through what is left of both without what differs.
    """
    own = cut(polygons.select("ord", "name", bare_name(F.col("name")).alias("form")).filter("form <> ''").groupBy("form").agg(F.min("ord").alias("ord"), F.max_by("name", "ord").alias("name")))
    rows = cut(items.select("id", bare_name(F.col("title")).alias("t"), bare_name(F.col("subtitle")).alias("s")))
    titles = rows.select("t").distinct()
    exact = titles.join(own.select(F.col("form").alias("t")), "t").select("t", F.col("t").alias("form"))
    open_ = cut(titles.join(exact.select("t"), "t", "left_anti"))
    forms = own.select("form", "ord")
    inside = _with_parts(open_, "t", _lengths(own, "form"), "form").join(forms, "form")
    around = _with_parts(forms, "form", _lengths(open_, "t"), "t").join(open_, "t")
    part = cut(inside.select("t", "form", "ord").unionByName(around.select("t", "form", "ord")).groupBy("t").agg(F.min_by("form", "ord").alias("form")))
    # Titles with nothing in them are inside no name and like none.
    left = cut(open_.join(part.select("t"), "t", "left_anti").filter("t <> ''"))
    pairs = alike_pairs(left, own)

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["ratio"] = [SequenceMatcher(None, b, a).ratio() for a, b in zip(pdf["t"], pdf["form"])]
            yield pdf

    like = pairs.mapInPandas(ratios, "t string, form string, ratio double").filter(F.col("ratio") >= PAIRED).groupBy("t").agg(F.max_by("form", F.struct("ratio", "form")).alias("form"))
    found = exact.withColumn("step", F.lit("exact")).unionByName(part.withColumn("step", F.lit("part"))).unionByName(like.withColumn("step", F.lit("like")))
    sub = _with_parts(rows.select("s").distinct(), "s", _lengths(own, "form"), "form").join(forms, "form").groupBy("s").agg(F.min_by("form", "ord").alias("__sub"))
    claims = rows.join(found, "t", "left").join(sub, "s", "left").withColumn("step", F.coalesce("step", F.when(F.col("__sub").isNotNull(), "subtitle"))).withColumn("form", F.coalesce("form", "__sub"))
    tally = claims.filter("form IS NOT NULL").join(own.select("form", "name"), "form").groupBy("name").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("step") == "exact").alias("exact"))
    out = claims.join(own.select("form", "name"), "form", "left").join(tally, "name", "left")
    wins = (F.col("claims") == 1) | ((F.col("exact") == 1) & (F.col("step") == "exact"))
    return out.select("id", F.when(wins, F.col("name")).alias("polygon"), F.when(wins, F.col("step")).alias("step"))


def hash_embedding(rows: DataFrame, id_col: str, text_col: str, buckets: int = 256) -> DataFrame:
    """id_col, vector: how often words of two letters or more fall into each bucket, to length one; sparse, as bucket -> weight.

    The first byte of a word's MD5 is its bucket, of which there are 256 at most. Counts are summed before they are shuffled, so a long
    text is no hot group. A text without words has an empty vector; ids are taken to be unique.
    """
    words = rows.select(id_col, F.explode_outer(F.regexp_extract_all(F.lower(text_col), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("word"))
    bucket = F.conv(F.substring(F.md5("word"), 1, 2), 16, 10).cast("int") % buckets
    counts = words.groupBy(id_col, bucket.alias("bucket")).agg(F.count("word").alias("n"))
    gathered = counts.groupBy(id_col).agg(F.collect_list(F.when(F.col("n") > 0, F.struct("bucket", "n"))).alias("pairs"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    return gathered.select(id_col, F.map_from_entries(F.transform("pairs", lambda p: F.struct(p.bucket, p.n / F.col("length")))).alias("vector"))


def resolve_shards(asked: DataFrame, shards: DataFrame) -> DataFrame:
    """selector, shard of selectors against shards (shard, slug, second_slug, name): by slug, second slug or name, else the shortest name that contains it; null for none."""
    keys = shards.select("shard", F.explode(F.array("slug", "second_slug", "name")).alias("selector")).filter("selector IS NOT NULL").groupBy("selector").agg(F.min("shard").alias("__own"))
    found = asked.select(F.trim("selector").alias("selector")).filter("selector <> ''").distinct().join(keys, "selector", "left")
    rest = found.filter("__own IS NULL").select("selector")
    pairs = contained(rest.select(F.col("selector").alias("inner")), shards.select(F.col("name").alias("outer")).filter("outer IS NOT NULL"), 1)
    named = pairs.select(F.col("inner").alias("selector"), F.col("outer").alias("name")).join(shards.select("shard", "name"), "name")
    inside = named.groupBy("selector").agg(F.min(F.struct(F.length("name").alias("n"), "shard")).getField("shard").alias("__part"))
    return found.join(inside, "selector", "left").select("selector", F.coalesce("__own", "__part").alias("shard"))
