"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k on their ratio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold_number, materialize
from .word_hashes import blocks, mix64, sums_by_row

#: Buckets of hashed word unigrams and bigrams.
BUCKETS = 10_000
#: Labelled rows, at most, from which the target model is fitted: those with the smallest hash of the id.
MAX_LABELLED = 20_000
SEED = 20_001


def _row_buckets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As word_hashes.blocks, with the buckets of each row's unigrams and bigrams."""
    for first, rows, hashes, counts in blocks(texts):
        ends = np.cumsum(counts)
        ones = (hashes % np.uint64(BUCKETS)).astype(np.int64)
        with np.errstate(over="ignore"):
            pairs = (mix64(hashes[:-1] * np.uint64(3) + hashes[1:]) % np.uint64(BUCKETS)).astype(np.int64) if len(hashes) else ones
        inside = np.ones(len(pairs), bool)
        inside[ends[(ends > 0) & (ends < len(hashes))] - 1] = False
        row = np.repeat(np.arange(rows), counts)
        values = np.concatenate([ones, pairs[inside]])
        of = np.concatenate([row, row[:-1][inside] if len(row) else row])
        order = np.argsort(of, kind="stable")
        yield first, rows, values[order], np.bincount(of, minlength=rows)


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts: summed in each task, then over tasks; the driver gets BUCKETS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, values, _ in _row_buckets(batch.column(0)):
                total += np.bincount(values, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.float64)
    for r in docs.select(F.col(text_col)).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def labelled_sample(labels: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most `most` labelled rows, the same ones at every run."""
    return labels.filter(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col, F.lit(SEED)), id_col).limit(most)


def log_ratios(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_grams, log_ratio: of each row, the log of its probability under the target's model over that under docs'.

    Both models give each bucket its share with one added. Null and empty texts have no n-grams and the ratio 0.
    """
    model = [np.log((c + 1) / (c.sum() + BUCKETS)) for c in (bucket_counts(target, text_col), bucket_counts(docs, text_col))]
    send = docs.sparkSession.sparkContext.broadcast(model[0] - model[1])
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = send.value
        for batch in batches:
            grams, ratio = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, rows, values, counts in _row_buckets(batch.column(1)):
                grams[first : first + rows] = counts
                ratio[first : first + rows] = sums_by_row(weight[values], counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams), pa.array(ratio)], [id_col, "n_grams", "log_ratio"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, n_grams bigint, log_ratio double")


def _kth(scored: DataFrame, k: int, key: str, id_col: str) -> tuple[float, int] | None:
    """(key, id) of the k-th row by key descending, id ascending: narrower and narrower counts, then a sort of a short rest."""
    low, high = scored.agg(F.min(key), F.max(key)).first()
    if low is None:
        return None
    left, rest = k, scored
    for _ in range(12):
        if high <= low:
            break
        step = (high - low) / 1024
        bins = rest.groupBy(F.least(F.floor((F.col(key) - low) / step), F.lit(1023)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        for r in sorted(bins.collect(), key=lambda r: -r["b"]):
            if left <= r["n"]:
                low, high, n = r["lo"], r["hi"], r["n"]
                break
            left -= r["n"]
        rest = scored.filter((F.col(key) >= low) & (F.col(key) <= high))
        if n <= 10_000:
            break
    # Rows that share one key to the last bit are told apart by id, a narrow sort of those alone.
    row = rest.orderBy(F.desc(key), F.asc_nulls_last(id_col)).limit(left).orderBy(F.asc(key), F.desc_nulls_first(id_col)).first()
    return row[key], row[id_col]


def resample(docs: DataFrame, target: DataFrame, keep_share: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_grams, log_ratio, gumbel_key, kept: a sample of round(keep_share * rows) rows without replacement.

    The k rows with the largest log_ratio plus Gumbel noise are a draw with weights exp(log_ratio). The noise comes from a
    hash of the id, so the draw is the same at every run; equal keys are told apart by the smaller id. Repeated rows are
    drawn alike. A null id is hashed as 0. No rows give no rows.
    """
    uniform = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(id_col), F.lit(0)), F.lit(SEED)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    scored = materialize(log_ratios(docs, target, id_col, text_col).withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(uniform))), "ratios")
    k = round(keep_share * scored.count())
    last = _kth(scored, k, "gumbel_key", id_col) if k else None
    if last is None:
        return scored.withColumn("kept", F.lit(False))
    inside = F.coalesce(F.col(id_col) <= F.lit(last[1]), F.lit(last[1] is None))
    return scored.withColumn("kept", (F.col("gumbel_key") > last[0]) | ((F.col("gumbel_key") == last[0]) & inside))


def target_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", most: int = MAX_LABELLED) -> tuple[DataFrame, float]:
    """Rows of docs that the bounded label sample marks as good, and the share of good rows in the sample."""
    sample = labelled_sample(labels.filter((fold_number(F.col(id_col), 5) != 0) & F.col("quality").isNotNull()), id_col, most)
    ids = materialize(sample.select(id_col, "quality"), "quality-sample")
    good, known = ids.agg(F.coalesce(F.sum("quality"), F.lit(0)), F.count(F.lit(1))).first()
    return docs.join(F.broadcast(ids.filter("quality = 1").select(id_col).distinct()), id_col, "left_semi"), (good / known if known else 1.0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    target, share = target_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return resample(docs, target, share)
