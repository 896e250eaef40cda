"""The rules on labelled rows: sentences and figures with the results that they must give."""

import pytest
from pyspark.sql import functions as F

from homerank import constants as C
from homerank.functions import geo, money, text

SHARED = (
    "هم‌خانه خانم نیازمندیم", "هم خونه برای آپارتمان دو خوابه", "جذب هم‌اتاقی دانشجو", "خوابگاه دخترانه نزدیک دانشگاه", "پانسیون مجهز با صبحانه", "اجاره اتاق مبله در آپارتمان",
    "اجاره‌ی یک اتاق ۳۰ متری", "رزرو تخت به صورت ماهانه", "هم‌خانه ميخواهيم", "هم‌‌خانه", "هم خانه",
)
NOT_SHARED = ("آپارتمان ۸۵ متری دو خوابه با آسانسور", "مناسب مجردی، فول امکانات", "فقط خانم، واحد ۶۰ متری", "هم سالن هم اتاق‌ها نورگیر است", "منطقه دانشجویی و پر رفت‌وآمد", None, "")
PARKING = (
    "اجاره پارکینگ", "اجاره پارکینگ مسقف", "پارکینگ اجاره ای در جوادیه", "رهن پارکینگ خودرو نزدیک مترو شهرری", "پارکینگ خودرو و موتور", "اجاره سالیانه و ماهانه پارکینگ", "اجاره یک جای پارکینگ",
    "اجاره پارکینک", "اجاره پارگینگ خودرو", "آجا پارکینگ", "پارکینگ", "پارکینگ اجاره‌ای",
)
NOT_PARKING = (
    "آپارتمان 70 متری با پارکینگ و انباری", "اجاره آپارتمان 45متری پارکینگ دار", "70متر پارکینگدار عربی", "اجاره 54 متر بدون پارکینگ واسانسور", "پارکینگ اصلی 64 متر طبقه دوم", "افسریه والفجر با پارکینگ",
    "نامجو-سلمان فارسی با پارکینگ", "پیروزی/نبرد/لرستان/55متربا پارکینگ", None, "",
)
NORMAL = (
    ("آپارتمان در يوسف اباد با كمد ديواري و ۱۲۳ متر", "آپارتمان در یوسف آباد با کمد دیواری و 123 متر"), ("٠١٢٣٤٥٦٧٨٩", "0123456789"), ("۰۱۲۳۴۵۶۷۸۹", "0123456789"), ("كتاب و يخچال", "کتاب و یخچال"),
    ("شهرکاباد تست", "شهرکاباد تست"), ("متن   با    فاصله  زیاد", "متن با فاصله زیاد"),
)


def labels(spark, rows, column):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, title string")
    return [r["x"] for r in table.select("i", column.alias("x")).orderBy("i").collect()]


def test_shared_living(spark):
    none = F.lit(None).cast("string")
    got = labels(spark, SHARED + NOT_SHARED, text.is_shared_living(F.col("title"), none))
    assert got == [True] * len(SHARED) + [False] * len(NOT_SHARED)
    assert labels(spark, ["آپارتمان ۷۰ متری"], text.is_shared_living(F.col("title"), F.lit("برای هم‌خانه شدن با یک نفر دیگر"))) == [True]


def test_parking_rentals(spark):
    assert labels(spark, PARKING + NOT_PARKING, text.is_parking_rental(F.col("title"))) == [True] * len(PARKING) + [False] * len(NOT_PARKING)


def test_not_a_home(spark):
    rows = [("اجاره پارکینگ مسقف", None, True), ("هم‌خانه خانم نیازمندیم", None, True), ("آپارتمان ۸۵ متری دو خوابه با آسانسور", None, False), ("آپارتمان ۷۰ متری دو خوابه", "دارای پارکینگ و انباری و آسانسور", False)]
    table = spark.createDataFrame(rows, "title string, description string, want boolean")
    assert all(r["x"] == r["want"] for r in table.select("want", text.is_not_a_home(F.col("title"), F.col("description")).alias("x")).collect())


def test_normalizer(spark):
    assert labels(spark, [a for a, _ in NORMAL], text.digits_fold(text.normalize(F.col("title")))) == [b for _, b in NORMAL]


def test_true_monthly_cost(spark):
    rows = [(100_000_000, 0, 3_000_000), (0, 15_000_000, 15_000_000), (200_000_000, 10_000_000, 16_000_000), (500_000_000, 25_000_000, 40_000_000)]
    table = spark.createDataFrame(rows, "deposit bigint, rent bigint, want bigint")
    assert all(r["x"] == r["want"] for r in table.select("want", money.tmc(F.col("deposit"), F.col("rent")).alias("x")).collect())


def test_distances(spark):
    rows = [(35.8044, 51.43, 35.6892, 51.4173), (35.7, 51.4, 35.7, 51.4)]
    table = spark.createDataFrame(rows, "a double, b double, c double, d double")
    far, same = [r["x"] for r in table.select(geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x")).collect()]
    assert far == pytest.approx(13.0, rel=0.1) and same == pytest.approx(0.0, abs=1e-9)
