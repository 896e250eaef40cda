"""A corpus run: language ID, toxicity, exact dedup, near dedup, packing, one after the other over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homerank.llm.common import discard, fold_number, materialize
from homerank.llm.exact_dedup import drop_exact_copies
from homerank.llm.language_id import fit, keep_known
from homerank.llm.near_dedup import drop_near_copies
from homerank.llm.packing import pack_documents
from homerank.llm.toxicity import drop_toxic, learn


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; trees from the documents' own language marks outside the held-out fifth.

    Null and empty texts, and those without a letter, have no language and go; repeated rows share one fate; no documents give none."""
    return keep_known(docs, fit(docs.filter(fold_number(F.col("doc_id"), 5) != 0)))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels outside the held-out fifth, does not find toxic.

    Null and empty texts stay; of several labels of a document the greatest counts; without labels nothing is learned."""
    learned = fold_number(F.col("doc_id"), 5) != 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, learn(docs.filter(learned), labels.filter(learned)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id. Null and empty texts are one text; of repeated rows one stays."""
    return drop_exact_copies(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more. Texts without words are linked with nothing
    and stay."""
    return drop_near_copies(docs, words=5)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences. Null and empty texts are the end id alone."""
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: Language ID and toxicity are learned models, which SQL cannot express; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is written and read back before the next, and deleted when that is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
