"""Skyline: rows that no other beats on cost, walk and size at once."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sweep(x: np.ndarray) -> np.ndarray:
    """Which of triples, all to be minimised, are not dominated: in order of the first, against a staircase of the others.

    Of the steps (second ascending, third descending) only the last one not beyond a point can dominate it.
    """
    triples, back = np.unique(x, axis=0, return_inverse=True)  # in lexicographic order: what dominates comes before
    keep, ys, zs = np.zeros(len(triples), bool), [], []
    for i, (_, y, z) in enumerate(triples.tolist()):
        at = bisect.bisect_right(ys, y)
        if at and zs[at - 1] <= z:
            continue
        keep[i] = True
        first = bisect.bisect_left(ys, y)
        end = first
        while end < len(ys) and zs[end] >= z:
            end += 1
        ys[first:end], zs[first:end] = [y], [z]
    return keep[back.ravel()]


def skyline(rows: DataFrame, key: str = "search_id", cost: str = "cost", walk: str = "metro_walk_mins", size: str = "area_sqm") -> DataFrame:
    """The rows that no other of their key beats. Equal triples do not beat each other, so all of them stay.

    Each partition is swept by itself first, batch by batch, which leaves few rows; those of a key are swept as one.
    """
    measured = rows.withColumn("__x", F.col(cost).cast("double")).withColumn("__y", F.col(walk).cast("double")).withColumn("__z", (-F.col(size)).cast("double"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[_sweep(pdf[["__x", "__y", "__z"]].to_numpy())]

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for pdf in batches:
            for k, part in pdf.groupby(key, dropna=False):
                kept[k] = best(pd.concat([kept[k], part]) if k in kept else part)
        yield from kept.values()

    survivors = measured.mapInPandas(local, measured.schema)
    return survivors.groupBy(key).applyInPandas(best, measured.schema).drop("__x", "__y", "__z")


def pareto(rows: DataFrame, key: str = "search_id", id_col: str = "id", cost: str = "cost", walk: str = "metro_walk_mins", size: str = "area_sqm") -> DataFrame:
    """rows with is_pareto; key and id_col name a row. The skyline is small and comes back by id."""
    mark = skyline(rows.select(key, id_col, cost, walk, size), key, cost, walk, size).select(key, id_col, F.lit(True).alias("is_pareto"))
    return rows.join(mark, [key, id_col], "left").withColumn("is_pareto", F.coalesce("is_pareto", F.lit(False)))
