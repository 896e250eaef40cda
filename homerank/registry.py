"""All queries of the library proper."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import catalog, linking, network, places, posts, searches, streams, studies  # noqa: F401  (the others add their queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each search."""
    return catalog.QUERIES["page"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
