"""Persian text rules as column expressions; classes such as \\s and \\d are Unicode-aware."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digit rows, letter pairs and the words that the rules look for.
PERSIAN_DIGITS, ARABIC_DIGITS, ASCII_DIGITS = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩", "0123456789"
MISSPELT, SPELT = "اباد", "آباد"
DIACRITICS = "[ً-ْٰ]"
JOINERS = "[​-‏]"
NO_ROOM = "بدون\\s*(?:اتاق|خواب)|فاقد\\s*(?:اتاق|خواب)|بدون\\s*اطاق|سوئیت|سوییت"
ROOM_DIGITS = "([0-9]+)\\s*(?:عدد\\s*)?(?:اتاق|اطاق|خواب)"
ROOM_WORD = "(یک|تک|دو|سه|چهار|پنج)\\s*(?:اتاق|اطاق|خواب)"
ROOM_WORDS = {"یک": 1, "تک": 1, "دو": 2, "سه": 3, "چهار": 4, "پنج": 5}
FLOOR_OF = "(-?[0-9]+)\\s*از\\s*([0-9]+)"
GROUND, BASEMENTS = "همکف", ("زیرزمین", "زیر همکف")
AREA = "([0-9]{2,4})\\s*(?:متر|متری|مترمربع|متر مربع)"
TOTAL_FLOORS = "(?:از|در|ساختمان)\\s*([0-9]{1,2})\\s*طبقه|([0-9]{1,2})\\s*طبقه\\s*(?:ساختمان)?"
BALCONY = (("بالکن", "تراس", "بالکون"), ("بدون بالکن", "بدون تراس", "فاقد بالکن"))
CONVERTIBLE = (("قابل تبدیل", "قابليت تبديل", "تبدیل میشود", "تبدیل می شود", "تبدیل به رهن", "کم و زیاد میشود"), ("غیر قابل تبدیل", "غیرقابل تبدیل", "بدون تبدیل"))
SHARED_LIVING = "هم\\s?خانه|هم\\s?خونه|هم\\s?اتاقی|هم\\s?منزل|هم\\s?سکونت|خوابگاه|پانسیون|اجاره\\s?(?:ی\\s?)?(?:یک\\s?)?اتاق|اتاق\\s?(?:برای\\s?)?اجاره|یک\\s?اتاق\\s?\\d+\\s?متر|اتاق\\s?مبله|اجاره\\s?تخت|رزرو\\s?تخت|تخت\\s?خواب\\s?اجاره"
PARKING_WORD = "پار[کگ]ین[گک]"
PARKING = f"(?:^|[\\s/،,\\-])(?:اجاره|رهن|کرایه|واگذاری)\\s*(?:\\S+\\s+){{0,3}}?{PARKING_WORD}|^\\s*{PARKING_WORD}|{PARKING_WORD}\\s*(?:اجاره|کرایه)|^\\s*(?:[^\\s\\d]+\\s+)?{PARKING_WORD}\\s*$"
DWELLING = "خواب|آپارتمان|اپارتمان|سوییت|سوئیت|مغازه|دفتر|طبقه|منزل|ویلا|خانه|اتاق|متری"
# Two more alternatives of the pattern above, which the SQL of the queries writes in another way, as it has no look-ahead.
DWELLING_EDGES = "واحد(?![یي])|متر\\b"


#: What \\s is with Unicode classes.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _u(pattern: str) -> str:
    return f"(?U){pattern}"


def digits_fold(text: Column) -> Column:
    return F.translate(text, PERSIAN_DIGITS + ARABIC_DIGITS, ASCII_DIGITS * 2)


def digits_persian(text: Column) -> Column:
    return F.translate(text.cast("string"), ASCII_DIGITS, PERSIAN_DIGITS)


def normalize(text: Column) -> Column:
    """Persian yeh and kaf, single spaces, and the misspelt whole word put right."""
    plain = F.trim(F.regexp_replace(F.translate(text, "يك", "یک"), _u("\\s+"), " "))
    return F.regexp_replace(plain, f"(?<!\\S){MISSPELT}(?!\\S)", SPELT)


def crawl_normalize(text: Column) -> Column:
    return F.translate(text, PERSIAN_DIGITS + ARABIC_DIGITS + "يكئ", ASCII_DIGITS * 2 + "یکی")


def match_form(text: Column) -> Column:
    """Names as matched: without diacritics, joiners as spaces, hamza carriers as plain letters."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), DIACRITICS, ""), JOINERS, " ")
    folded = F.translate(bare, "آأإٱئؤةۀء", "اااایوهه")
    return F.trim(F.regexp_replace(normalize(folded), _u("\\s+"), " "))


def squash_form(text: Column) -> Column:
    return F.replace(match_form(text), F.lit(" "), F.lit(""))


def prepared(text: Column) -> Column:
    return normalize(digits_fold(F.coalesce(text, F.lit(""))))


def first_integer(text: Column) -> Column:
    """All digits of a value, joined, as a number."""
    return F.regexp_replace(digits_fold(text), "[^0-9]", "").try_cast("bigint")


def mine_rooms(text: Column) -> Column:
    digits = F.regexp_extract(text, ROOM_DIGITS, 1)
    number = digits.try_cast("int")
    words = F.create_map(*[F.lit(x) for kv in ROOM_WORDS.items() for x in kv])
    return F.when(text.rlike(_u(NO_ROOM)), 0).when(digits != "", F.when(number.between(0, 10), number)).otherwise(F.try_element_at(words, F.regexp_extract(text, ROOM_WORD, 1)))


def mine_floor(text: Column) -> Column:
    """The floor of a floor attribute: of "3 of 5", a bare number, the ground floor or a basement."""
    pair = F.regexp_extract(text, FLOOR_OF, 1)
    return F.when(pair != "", pair.try_cast("int")).when(text.rlike("^-?[0-9]+$"), text.try_cast("int")).when(text.contains(GROUND), 0).when(text.contains(BASEMENTS[0]) | text.contains(BASEMENTS[1]), -1)


def mine_floor_total(text: Column) -> Column:
    return F.regexp_extract(text, FLOOR_OF, 2).try_cast("int")


def mine_total_floors(text: Column) -> Column:
    """The first plausible building height."""
    found = F.zip_with(F.regexp_extract_all(text, F.lit(TOTAL_FLOORS), F.lit(1)), F.regexp_extract_all(text, F.lit(TOTAL_FLOORS), F.lit(2)), lambda a, b: F.coalesce(a.try_cast("int"), b.try_cast("int")))
    return F.try_element_at(F.filter(found, lambda x: x.between(1, 40)), F.lit(1))


def mine_area(text: Column) -> Column:
    from ..constants import AREA_LIMITS

    found = F.transform(F.regexp_extract_all(text, F.lit(AREA), F.lit(1)), lambda x: x.try_cast("int"))
    return F.try_element_at(F.filter(found, lambda x: x.between(*AREA_LIMITS)), F.lit(1))


def mentions(text: Column, positives: tuple[str, ...], negatives: tuple[str, ...]) -> Column:
    """False for a denial, true for a mention, else null."""
    has = lambda words: text.rlike("|".join(words))
    return F.when(has(negatives), False).when(has(positives), True)


def one_line(*parts: Column) -> Column:
    """Texts as the rules on adverts read them: normalised, on one line, with zero-width non-joiners as spaces."""
    return F.regexp_replace(normalize(F.concat_ws(" ", *parts)), _u("[\u200c\\s]+"), " ")


def is_shared_living(title: Column, description: Column) -> Column:
    return one_line(title, description).rlike(_u(SHARED_LIVING))


def is_parking_rental(title: Column) -> Column:
    """Whether a parking space is what the title lets. A null title lets none."""
    line = one_line(title)
    return line.rlike(_u(PARKING)) & ~line.rlike(_u(f"{DWELLING}|{DWELLING_EDGES}"))


def is_not_a_home(title: Column, description: Column) -> Column:
    return is_shared_living(title, description) | is_parking_rental(title)


def drop_promo_lines(text: Column, promo: str = "آخرین نردبان") -> Column:
    """Without promotion lines and blank lines; null when nothing is left."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith(promo))
    return F.nullif(F.array_join(lines, "\n"), F.lit(""))


def search_text(*parts: Column) -> Column:
    return prepared(F.concat_ws(" ", *parts))
