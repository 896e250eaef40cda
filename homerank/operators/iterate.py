"""What iterative operators share: cut lineage and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.prepared import shared_root


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint below `spark.checkpoint.dir`; only a local session without that setting gets a folder of its own."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(root or f"file://{tempfile.mkdtemp(prefix='spark-scratch-')}")
    return df.checkpoint()


def cut_packed(df: DataFrame) -> DataFrame:
    """df from Parquet in the same folder: for large tables that many rounds read, a fifth of a checkpoint's size or less."""
    path = f"{shared_root(df.sparkSession)}/homerank/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of nodes (id) under links (a, b) read both ways.

    Each round takes the least label around a node and then that label's own label, so chains shorten by a factor a round.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels = cut(nodes.select("id", F.col("id").alias("component")).distinct())
    while True:
        around = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        least = labels.join(around, labels.id == around.a, "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        up = labels.select(F.col("id").alias("low"), F.col("component").alias("top"))
        new = cut(least.join(up, "low").select("id", F.least("low", "top").alias("component"), (F.least("low", "top") != F.col("component")).alias("moved")))
        labels = new.select("id", "component")
        if new.filter("moved").isEmpty():
            return labels
