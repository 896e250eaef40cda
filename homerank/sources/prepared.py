"""Tables that are derived once and read by many queries, kept as Parquet in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_kept: dict[tuple[str, str, str], tuple[str, StructType]] = {}
_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; only a local session without that setting gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append(f"file://{tempfile.mkdtemp(prefix='spark-scratch-')}")
    return _own_root[0]


#: Lines of a packed file, which one task reads: some 50 MB of JSON.
FILE_LINES = 10_000


def kept_text(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> str:
    """The folder of the lines that make() gives in its one column, written as packed text files at their first use in an application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        path = f"{shared_root(spark)}/homerank/{name}-{uuid.uuid4().hex}"
        make().write.option("maxRecordsPerFile", FILE_LINES).text(path, compression="gzip")
        _kept[key] = path, StructType()
    return _kept[key][0]


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` over the data in sf_dir: written at its first use in an application, read from then on. Input that changes under
    one path within an application is not seen."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        path, made = f"{shared_root(spark)}/homerank/{name}-{uuid.uuid4().hex}", make()
        made.write.parquet(path)
        _kept[key] = path, made.schema
    path, schema = _kept[key]
    return spark.read.schema(schema).parquet(path)
