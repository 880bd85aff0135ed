"""Top-k, pages and ordinals. Every order ends in a unique key, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of an order; each task keeps n rows before anything is shuffled."""
    if not 1 <= n <= 100_000:
        raise ValueError("between 1 and 100000 rows")
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, id_: str, n: int, after=None) -> DataFrame:
    """The newest ``n`` rows, or the newest below the cursor ``after``; the cursor is a filter that scans can prune by."""
    df = df if after is None else df.filter(F.col(id_) < after)
    return top(df, n, F.col(id_).desc())


def browse(df: DataFrame, offset: int, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(n)


def ordinals(df: DataFrame, by: list[str], order: list[str], name: str = "ordinal", start: Column | int = 0) -> DataFrame:
    """1-based rank within a group, shifted by ``start``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) + start)


def first_rows(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key under a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")
