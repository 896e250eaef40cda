"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups, keep one stable id of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold_az

_H, _SHA, _TEXT, _ID = "__hr_h", "__hr_sha", "__hr_norm", "__hr_id"


def _keyed(docs: DataFrame, id_col: str, text_col: str, content_hash) -> DataFrame:
    norm = fold_az(F.col(text_col))
    hashed = content_hash(norm) if content_hash else F.unhex(F.md5(norm.cast("binary")))
    return docs.select(F.col(id_col).alias(_ID), norm.alias(_TEXT), hashed.alias(_H), F.sha2(norm.cast("binary"), 256).alias(_SHA))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", content_hash=None) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the 128-bit hash (MD5) of the folded text; the text itself is a grouping key beside the hash, so
    the aggregation compares bytes and rows whose hashes collide stay apart. Map-side aggregation sends each distinct
    text once per task, so a text that fills a third of the table makes no large group. The rows then find their class
    by hash and SHA-256 in a join that adaptive execution can split where one class is hot.

    keep: "min" or "max", the id of each class that stays. Null and empty texts are equal to each other; a null id loses
    against any other, and a class with null ids only keeps null (kept is then true). Repeated rows with one id are one
    document: all of them report kept alike. No rows give no rows; other columns, whatever their names, are ignored.
    content_hash: text Column -> hash Column, in place of MD5 (tests force collisions with it).
    """
    rows = _keyed(docs, id_col, text_col, content_hash)
    best = F.min(_ID) if keep == "min" else F.max(_ID)
    classes = rows.groupBy(_H, _SHA, _TEXT).agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size")).drop(_TEXT)
    labelled = rows.select(_ID, _H, _SHA).join(classes, [_H, _SHA])
    return labelled.select(F.col(_ID).alias(id_col), "keep_id", "group_size", F.col(_ID).eqNullSafe(F.col("keep_id")).alias("kept"), F.col(_SHA).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs, all columns, that exact_dedup keeps: one for each distinct text, of repeated rows one too."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order: Column = F.coalesce(F.col(id_col), F.lit(1 << 62 if keep == "min" else -(1 << 62)))
    keyed = docs.select(F.unhex(F.md5(fold_az(F.col(text_col)).cast("binary"))).alias(_H), fold_az(F.col(text_col)).alias(_TEXT), order.alias(_ID), whole.alias("__hr_row"))
    pick = F.min_by if keep == "min" else F.max_by
    return keyed.groupBy(_H, _TEXT).agg(pick("__hr_row", _ID).alias("__hr_row")).select("__hr_row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="max")


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
