"""Document fingerprints by winnowing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

#: Tokens in a gram and grams in a window: any shared run of K + W - 1 tokens shares a fingerprint.
K, W = 5, 8
#: A longer run without white space has a token of so many characters, fewer at its end, at each of its characters.
TOKEN_CHARS = 16
TOKEN = rf"(?=(\S{{1,{TOKEN_CHARS}}}))(?:(?<!\S)\S{{1,{TOKEN_CHARS}}}(?!\S)|\S)"
#: Low bits of a fingerprint hold its position, counted from the end of the range so that the rightmost of equal hashes is least.
#: A string has less than 2^31 bytes and a token takes two at least, or one inside a run, whose array would be larger than a row may be.
POSITION_BITS = 30
_MASK = (1 << POSITION_BITS) - 1
#: Rows of one bucket of neighbouring ids, about, and buckets at most; beyond 100 million rows buckets grow, as windows that spill.
BUCKET_ROWS, MAX_BUCKETS = 1_000, 100_000


def _shifted(df: DataFrame, out: str, a: str, b: str, by: int, combine) -> DataFrame:
    """out[i] = combine(a[i], b[i + by]) while both are there."""
    n = F.greatest(F.least(F.size(a), F.size(b) - by), F.lit(0))
    return df.withColumn(out, F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(by + 1), n), combine))


def winnow(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the array `out`: each text's fingerprints in order, hash above position.

    Tokens are runs without white space; in runs longer than TOKEN_CHARS each character begins a token, so a passage in text
    without spaces has the same tokens wherever it stands in its run. Each gram of K tokens has a hash, rolled up from
    the hashes of its halves; of each W grams in a row the least hash is kept, of equal ones the rightmost, and once only.
    A text with fewer tokens than K is one gram, one with fewer grams than W one window; without tokens a non-empty text
    is one gram by itself and an empty text has no fingerprint. Each step is a column of its own, so that no step is
    computed within another's loop.
    """
    t, h, g2, g4, g, v, m2, m4, m8 = (f"__hr_{out}_{i}" for i in range(9))
    pair, least = (lambda a, b: F.xxhash64(a, b)), (lambda a, b: F.least(a, b))
    df = df.withColumn(t, F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(1)))
    df = df.withColumn(h, F.transform(t, lambda x: F.xxhash64(x)))
    df = _shifted(df, g2, h, h, 1, pair)
    df = _shifted(df, g4, g2, g2, 2, pair)
    df = _shifted(df, g, g4, h, K - 1, pair)
    whole = F.when(F.length(text) > 0, F.array(F.xxhash64(text))).otherwise(F.array().cast("array<bigint>"))
    few = F.when(F.size(h) == 0, whole).otherwise(F.array(F.xxhash64(F.array_join(t, " "))))
    df = df.withColumn(v, F.transform(F.when(F.size(h) < K, few).otherwise(F.col(g)), lambda x, i: F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(~_MASK)).bitwiseOR(F.lit(_MASK) - i.cast("bigint").bitwiseAND(F.lit(_MASK)))))
    df = _shifted(df, m2, v, v, 1, least)
    df = _shifted(df, m4, m2, m2, 2, least)
    df = _shifted(df, m8, m4, m4, 4, least)
    one = F.when(F.size(v) > 0, F.array(F.array_min(v))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(out, F.when(F.size(v) < W, one).otherwise(F.array_distinct(m8)))
    return df.drop(t, h, g2, g4, g, v, m2, m4, m8)


def hashes_of(prints: Column | str) -> Column:
    return F.array_distinct(F.transform(prints, lambda x: F.shiftright(x, POSITION_BITS)))


def positions_of(prints: Column | str) -> Column:
    """The token at which each kept gram begins."""
    return F.transform(prints, lambda x: F.lit(_MASK) - x.bitwiseAND(F.lit(_MASK)))


def as_text(prints: Column | str) -> Column:
    """hash@position of each fingerprint, in order."""
    return F.array_join(F.transform(prints, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, POSITION_BITS))), F.lit("@"), (F.lit(_MASK) - x.bitwiseAND(F.lit(_MASK))).cast("string"))), " ")


def likeness(a: str, b: str) -> Column:
    """Shared over all distinct hashes; 1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, object]:
    """Rows (__hr_id, __hr_text, __hr_next) with the next row's text by ascending id, the first row's after the last; the window.

    Rows are dealt into buckets of neighbouring ids, by quantiles, so no task has to sort them all; the first row of each
    bucket goes to the bucket before as well, where it is the last and is only looked at. The driver gets a few numbers
    for each bucket, of which there are MAX_BUCKETS at most.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col(id_col), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).alias("__hr_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__hr_text"), order.alias("__hr_order"), order.cast("double").alias("__hr_x"))
    n = docs.count()
    buckets = min(MAX_BUCKETS, max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // BUCKET_ROWS))
    cuts = sorted(set(rows.approxQuantile("__hr_x", [i / buckets for i in range(1, buckets)], 0.2 / buckets))) if n else []
    dealt = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="__hr_x", outputCol="__hr_bucket").transform(rows) if cuts else rows.withColumn("__hr_bucket", F.lit(0.0))
    firsts = sorted((r["b"], r["o"]) for r in dealt.groupBy(F.col("__hr_bucket").alias("b")).agg(F.min("__hr_order").alias("o")).collect())
    back = [(o, firsts[i - 1][0], int(i == 0)) for i, (_, o) in enumerate(firsts)]
    heads = spark.createDataFrame(back, "__hr_order bigint, before double, wrap int")  # one row a bucket: MAX_BUCKETS rows at most
    placed = dealt.join(F.broadcast(heads), "__hr_order", "left").withColumn("__hr_at", F.explode(F.array_compact(F.array(
        F.struct(F.col("__hr_bucket").alias("bucket"), F.lit(0).alias("copy"), F.lit(0).alias("wrap")),
        F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("copy"), F.col("wrap"))),
    ))))
    placed = placed.select("__hr_id", "__hr_text", "__hr_order", F.col("__hr_at.bucket").alias("__hr_bucket"), F.col("__hr_at.copy").alias("__hr_copy"), F.col("__hr_at.wrap").alias("__hr_wrap"), F.xxhash64("__hr_text").alias("__hr_tie"))
    window = Window.partitionBy("__hr_bucket").orderBy("__hr_wrap", "__hr_copy", "__hr_order", "__hr_tie")
    return placed.withColumn("__hr_next", F.lead("__hr_text").over(window)), window


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprints and those of its edit, whose last quarter is taken from the next document.

    Columns: id_col, n_chars, edited_sha256, prints, edited_prints (arrays, hash above position), near_edited, near_next.
    Null is empty. Rows with equal ids are neighbours, ordered by a hash of the text; a null id comes first. One row is
    its own next. No rows give no rows; other columns are ignored.
    """
    rows, window = with_next(docs, id_col, text_col)
    rows = winnow(rows, "__hr_text", "prints").withColumn("__hr_h", hashes_of("prints"))
    rows = rows.withColumn("__hr_next_h", F.lead("__hr_h").over(window)).filter("__hr_copy = 0")
    n = F.length("__hr_text")
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("__hr_q", F.floor(n / 4).cast("int"))
    rows = rows.withColumn("__hr_edited", F.concat(F.substring("__hr_text", F.lit(1), n - F.col("__hr_q")), F.substring("__hr_next", F.lit(1), F.col("__hr_q"))))
    rows = winnow(rows, "__hr_edited", "edited_prints").withColumn("__hr_edited_h", hashes_of("edited_prints"))
    return rows.select(
        F.col("__hr_id").alias(id_col), "n_chars", F.sha2(F.col("__hr_edited").cast("binary"), 256).alias("edited_sha256"), "prints", "edited_prints",
        likeness("__hr_h", "__hr_edited_h").alias("near_edited"), likeness("__hr_h", "__hr_next_h").alias("near_next"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprint_documents(documents(spark, sf_dir))
    return made.select("doc_id", "n_chars", "edited_sha256", as_text("prints").alias("fingerprint"), as_text("edited_prints").alias("edited_fingerprint"), "near_edited", "near_next")
