"""Positions of rows within their group, where one group may hold most of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import materialize

_TIE, _PART, _LOCAL = "__hr_tie", "__hr_part", "__hr_local"


def ranked(df: DataFrame, key: str, order: list[Column], name: str, index: str = "index") -> DataFrame:
    """df with `index`, the place of each row among those of its key, from 0, in the given order; rows that are equal in it stand in
    any one order. `key` must not be null.

    The rows are dealt into ranges of (key, order), so that a key that holds a third of the table is split like any other; each task
    numbers its own rows, and a range's first key starts where the ranges before it end. These starts are at most two rows a range,
    which is what is broadcast. Rows that are equal in everything are told apart by where they were read. df is read twice (once for
    the bounds of the ranges): give a table.
    """
    columns = df.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(columns.index(key))
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = last is None or keys[0] != last
            places = np.arange(n)
            begins = np.maximum.accumulate(np.where(new, places, -1))
            local = np.where(begins < 0, places + count, places - begins)
            last, count = keys[n - 1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), pa.array(np.full(n, part, np.int32)), pa.array(local)], [*columns, _PART, _LOCAL])

    every = [F.col(key), *order, F.col(_TIE)]
    dealt = df.withColumn(_TIE, F.monotonically_increasing_id()).repartitionByRange(*every).sortWithinPartitions(*every).select(*[F.col(f"`{c}`") for c in columns])
    out_schema = StructType([*df.schema.fields, StructField(_PART, IntegerType()), StructField(_LOCAL, LongType())])
    numbered = materialize(dealt.mapInArrow(number, out_schema), f"{name}-numbered")
    runs = numbered.groupBy(key, _PART).agg((F.max(_LOCAL) + 1).alias("n"))
    several = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(_PART, "n"))).alias("runs")).filter(F.size("runs") > 1)
    before = F.aggregate(F.slice("runs", 1, F.col("i")), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    starts = several.select(key, "runs", F.explode(F.sequence(F.lit(0), F.size("runs") - 1)).alias("i")).select(key, F.col("runs")[F.col("i")][_PART].alias(_PART), before.alias("__hr_before"))
    placed = numbered.join(F.broadcast(starts), [key, _PART], "left")
    return placed.select(*[F.col(f"`{c}`") for c in columns], (F.col(_LOCAL) + F.coalesce(F.col("__hr_before"), F.lit(0))).alias(index))
