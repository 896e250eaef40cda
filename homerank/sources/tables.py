"""Adverts, stations, areas and searches, derived from the given tables; each rule reads alike in Spark SQL and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Titles of adverts, dealt by key.
TITLES = (
    "آپارتمان دو خواب نوساز", "اجاره اتاق به خانم", "۳ خواب نورگیر فول", "پارکینگ مسقف", "سوئیت مبله", "اجاره پارکینگ غیرمزاحم",
    "واحد 85 متری یک خواب", "هم خانه خانم", "يك خواب اباد", "طبقه ۳ از ۵ بازسازی", "بدون خواب", "خوابگاه دخترانه", "منزل ویلایی ٤ خواب",
    "در 6 طبقه ساختمان 120 متر", "بدون بالکن دو اتاق", "تراس بزرگ سه خواب ۹۰ متر", "قابل تبدیل دو خواب", "غیرقابل تبدیل 70 متر",
    # With zero-width non-joiners, as adverts are mostly spelt.
    "هم\u200cخانه خانم نیازمندیم", "جذب هم\u200cاتاقی دانشجو", "اجاره\u200cی یک اتاق", "پارکینگ اجاره\u200cای", "هم سالن هم اتاق\u200cها نورگیر",
)

LISTING = [
    "'o-' || CAST(o_orderkey AS STRING) AS id",
    "CAST(floor(o_totalprice) AS BIGINT) * 1000 AS deposit",
    "(o_orderkey * 7919 % 40000) * 1000 AS rent",
    "30 + o_orderkey * 31 % 171 AS area_sqm",
    "o_orderkey * 13 % 5 AS rooms",
    "o_orderkey * 7 % 13 - 2 AS floor",
    "greatest(o_orderkey * 7 % 13 - 2, 1) + o_orderkey % 4 AS total_floors",
    "o_orderkey * 11 % 31 AS building_age",
    "CASE WHEN o_orderkey % 17 <> 0 THEN 1405 - o_orderkey * 11 % 31 END AS build_year",
    "o_orderkey % 2 = 0 AS has_elevator",
    "o_orderkey % 3 <> 1 AS has_parking",
    "o_orderkey % 5 < 3 AS has_balcony",
    "o_orderkey % 7 < 5 AS has_storage",
    "o_orderkey % 3 <> 0 AS can_convert",
    "CASE WHEN o_orderkey % 4 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) * 1000 + (o_orderkey * 7919 % 40000) * 10000 END AS convertible_deposit_max",
    "(o_orderkey * 7919 % 40000) * 1000 <= 100000 AS is_full_deposit",
    "o_orderkey % 20 = 0 AS is_shared",
    "o_orderkey % 9 AS image_count",
    "(35550000 + o_orderkey * 104729 % 300000) / CAST(1000000 AS DOUBLE) AS lat",
    "(51100000 + o_orderkey * 1299709 % 500000) / CAST(1000000 AS DOUBLE) AS lon",
    "o_orderkey AS ingest_seq",
]
STATION = [
    "s_suppkey AS station_id",
    "s_name AS name",
    # Each tenth station lies a short walk from the one before it, and another tenth next door.
    "(35550000 + (s_suppkey - CASE WHEN s_suppkey % 10 IN (4, 7) THEN 1 ELSE 0 END) * 7368787 % 300000 + CASE s_suppkey % 10 WHEN 7 THEN 2500 WHEN 4 THEN 700 ELSE 0 END) / CAST(1000000 AS DOUBLE) AS lat",
    "(51100000 + (s_suppkey - CASE WHEN s_suppkey % 10 IN (4, 7) THEN 1 ELSE 0 END) * 15485863 % 500000) / CAST(1000000 AS DOUBLE) AS lon",
    "CASE WHEN s_suppkey % 5 = 0 THEN 'brt' ELSE 'metro' END AS type",
    "CAST(s_nationkey % 7 + 1 AS STRING) AS line",
    "CASE WHEN s_suppkey % 10 = 3 THEN CAST(s_suppkey % 7 + 1 AS STRING) END AS second_line",
]
#: South-west corner of an area's tile, in steps of 0.06 by 0.10 degrees, inset, moved off all fixture points.
AREA = [
    "'a' || CAST(n_nationkey AS STRING) AS area_key",
    "n_name AS title",
    "n_nationkey AS ord",
    "35.5530005E0 + 0.06E0 * floor(n_nationkey / CAST(5 AS DOUBLE)) AS lat0",
    "51.1050005E0 + 0.10E0 * (n_nationkey % 5) AS lon0",
]
#: Corners of an area as shares of its height and width: an octagon.
CORNERS = ((0.0, 0.2), (0.0, 0.8), (0.2, 1.0), (0.8, 1.0), (1.0, 0.8), (1.0, 0.2), (0.8, 0.0), (0.2, 0.0))
AREA_HEIGHT, AREA_WIDTH = 0.054, 0.09
#: Columns of a search with their types and what they are when nothing is said.
INTENT = {
    "search_id": ("bigint", None), "min_deposit": ("bigint", None), "max_deposit": ("bigint", None), "min_rent": ("bigint", None), "max_rent": ("bigint", None), "min_area": ("bigint", None), "max_area": ("bigint", None),
    "min_rooms": ("bigint", None), "min_floor": ("bigint", None), "max_floor": ("bigint", None), "min_build_year": ("bigint", None), "wants_elevator": ("boolean", False), "wants_parking": ("boolean", False), "wants_storage": ("boolean", False),
    "wants_balcony": ("boolean", False), "wants_images": ("boolean", False), "full_deposit_only": ("boolean", False), "convertible_only": ("boolean", False), "living_kind": ("string", "standard"), "area_keys": ("array<string>", []),
    "persona": ("string", "balanced"), "workplace_lat": ("double", None), "workplace_lon": ("double", None), "commute_mode": ("string", "transit"), "max_commute": ("bigint", 45), "commute_importance": ("double", 0.5),
    "soft_vec": ("bigint", None), "user_weights": ("array<double>", None),
}
#: Searches: the flagship; none of the conditions; a rent cap alone; little cash; a workplace; drawn areas of the shared market; a taste; weights that add up to nothing; many hard conditions.
INTENTS = (
    {"search_id": 1, "max_deposit": 300_000_000, "max_rent": 25_000_000, "min_area": 60, "max_area": 120},
    {"search_id": 2},
    {"search_id": 3, "max_deposit": 0, "max_rent": 20_000_000},
    {"search_id": 4, "max_deposit": 50_000_000, "max_rent": 30_000_000, "persona": "prefer_higher_rent", "wants_parking": True, "wants_elevator": True},
    {"search_id": 5, "workplace_lat": 35.70, "workplace_lon": 51.40, "commute_importance": 1.0},
    {"search_id": 6, "area_keys": ["a7", "a12"], "living_kind": "shared"},
    {"search_id": 7, "soft_vec": 0, "user_weights": [0.2, 0.1, 0.0, 0.3, 0.1, 0.1, 0.1, 0.0, 0.5]},
    {"search_id": 8, "user_weights": [0.0] * 9, "min_area": 80, "persona": "prefer_higher_deposit"},
    {"search_id": 9, "min_deposit": 20_000_000, "min_rent": 1_000_000, "min_rooms": 1, "min_floor": 1, "max_floor": 9, "min_build_year": 1380, "wants_storage": True, "wants_balcony": True, "wants_images": True, "convertible_only": True, "workplace_lat": 35.62, "workplace_lon": 51.3, "commute_mode": "drive"},
    {"search_id": 10, "full_deposit_only": True, "workplace_lat": 35.71, "workplace_lon": 51.41, "commute_mode": "walk", "max_area": 150},
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*LISTING)


def adverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, description, area_sqm, deposit, rent."""
    titles = "array(" + ", ".join(f"'{t}'" for t in TITLES) + ")"
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", f"try_element_at({titles}, CAST(o_orderkey % {len(TITLES)} + 1 AS INT)) AS title", f"try_element_at({titles}, CAST(o_orderkey * 5 % {len(TITLES)} + 1 AS INT)) AS description")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*STATION)


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = ", ".join(f"named_struct('lat', lat0 + {AREA_HEIGHT}E0 * {a}E0, 'lon', lon0 + {AREA_WIDTH}E0 * {b}E0)" for a, b in CORNERS)
    base = table(spark, sf_dir, "nation").selectExpr(*AREA)
    return base.selectExpr("area_key", "title", "ord", "lat0 AS min_lat", f"lat0 + {AREA_HEIGHT}E0 AS max_lat", "lon0 AS min_lon", f"lon0 + {AREA_WIDTH}E0 AS max_lon", f"lat0 + {AREA_HEIGHT}E0 / 2 AS center_lat", f"lon0 + {AREA_WIDTH}E0 / 2 AS center_lon", f"array({corners}) AS ring")


def intents(spark: SparkSession) -> DataFrame:
    rows = [tuple(i.get(c, default) for c, (_, default) in INTENT.items()) for i in INTENTS]
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, (t, _) in INTENT.items()))


def _sql(x, kind: str) -> str:
    kind = {"string": "VARCHAR", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]"}.get(kind, kind)
    value = "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return f"CAST({value} AS {kind})"


_ELEMENT = "[" + ", ".join(f"'{t}'" for t in TITLES) + "]"
_EDGES = list(zip(CORNERS, [*CORNERS[1:], CORNERS[0]]))
#: The same tables for DuckDB.
CTE = {
    "listings": f"SELECT {', '.join(LISTING)} FROM orders".replace("AS STRING", "AS VARCHAR"),
    "stations": f"SELECT {', '.join(STATION)} FROM supplier".replace("AS STRING", "AS VARCHAR"),
    "area_base": f"SELECT {', '.join(AREA)} FROM nation".replace("AS STRING", "AS VARCHAR"),
    "areas": f"SELECT area_key, title, ord, lat0 AS min_lat, lat0 + {AREA_HEIGHT}E0 AS max_lat, lon0 AS min_lon, lon0 + {AREA_WIDTH}E0 AS max_lon, lat0 + {AREA_HEIGHT}E0 / 2 AS center_lat, lon0 + {AREA_WIDTH}E0 / 2 AS center_lon FROM area_base",
    "edges": " UNION ALL ".join(f"SELECT area_key, {i} AS i, lat0 + {AREA_HEIGHT}E0 * {a[0]}E0 AS y1, lon0 + {AREA_WIDTH}E0 * {a[1]}E0 AS x1, lat0 + {AREA_HEIGHT}E0 * {b[0]}E0 AS y2, lon0 + {AREA_WIDTH}E0 * {b[1]}E0 AS x2 FROM area_base" for i, (a, b) in enumerate(_EDGES)),
    "adverts": f"SELECT o_orderkey AS k, ({_ELEMENT})[o_orderkey % {len(TITLES)} + 1] AS title, ({_ELEMENT})[o_orderkey * 5 % {len(TITLES)} + 1] AS description FROM orders",
    "intents": " UNION ALL ".join("SELECT " + ", ".join(f"{_sql(i.get(c, default), t)} AS {c}" for c, (t, default) in INTENT.items()) for i in INTENTS),
}


def with_tables(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in names)
