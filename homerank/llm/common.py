"""What the text operators share: scratch tables, folds, text rules and bounded broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For str.translate: lower-cases A-Z and nothing else.
FOLD_AZ = {ord(a): b for a, b in zip(UPPER, LOWER)}
#: A word is a run of bytes other than these.
WORD_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Side tables are broadcast up to this size in bytes; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 64 << 20

#: Bytes of a batch of rows on its way to Python; one longer row is a batch by itself.
BATCH_BYTES = 2 << 20

_own_scratch: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Only a local session without one gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="spark-scratch-"))
    return f"file://{_own_scratch[0]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/homerank/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back, which cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files below a materialized table that is no longer read."""
    spark = df.sparkSession
    hadoop = spark._jsc.hadoopConfiguration()
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose texts its session sends to Python in batches of at most BATCH_BYTES from here on: a worker holds several copies of a batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold_az(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fold_number(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus


def words(text: str | None) -> list[str]:
    """Words of a text after A-Z are lower-cased: runs of characters other than the six ASCII white spaces."""
    if not text:
        return []
    text = text.lower() if text.isascii() else text.translate(FOLD_AZ)
    parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    return parts if "" not in parts else [w for w in parts if w]


def fits_broadcast(df: DataFrame, row_bytes: int) -> bool:
    """Whether df, at so many bytes a row, stays below the limit for broadcasts; counts no further than the limit."""
    most = BROADCAST_BYTES // row_bytes
    return df.limit(most + 1).count() <= most
