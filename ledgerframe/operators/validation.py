"""Checks on stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def collection_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n") for name, df in tables.items()])


def stale_page_rows(page: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Rows of a page that the state does not hold any more; a correct page has none."""
    return page.join(state.select(key), key, "left_anti")


def strictly_increasing(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is not above the one before; none if the framing is right."""
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_before", before).filter(F.col(value) <= F.col("_before")).drop("_before")


def order_statistics(df: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.99)) -> DataFrame:
    """(share, value): the element at position floor(n x share) of the sorted values. Equal values are counted first, so only
    distinct ones are put in order."""
    per = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    run = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    hits = [F.struct(F.lit(s).alias("share"), F.min(F.when(F.col("upto") > F.least(F.floor(F.col("total") * s), F.col("total") - 1), F.col(value))).alias("value")) for s in shares]
    return per.agg(F.array(*hits).alias("x")).select(F.inline("x")).filter("value is not null")


def mismatches(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(key, column, left, right) of every value that differs between two answers; a row that one side lacks differs as a whole
    (column ``*``). Keys are unique on both sides."""
    values = [c for c in left.columns if c not in key]
    l = left.select(*key, F.struct(*values).alias("_l"))
    r = right.select(*key, F.struct(*[c for c in right.columns if c not in key]).alias("_r"))
    text = lambda c: c.cast("string")
    both = l.join(r, key, "full_outer")
    lone = F.array(F.struct(F.lit("*").alias("column"), F.when(F.col("_l").isNotNull(), "present").alias("left"), F.when(F.col("_r").isNotNull(), "present").alias("right")))
    each = F.array(*[F.struct(F.lit(v).alias("column"), text(F.col(f"_l.{v}")).alias("left"), text(F.col(f"_r.{v}")).alias("right")) for v in values])
    differing = F.filter(each, lambda x: ~x["left"].eqNullSafe(x["right"]))
    return both.select(*key, F.explode(F.when(F.col("_l").isNull() | F.col("_r").isNull(), lone).otherwise(differing)).alias("x")).select(*key, "x.*")


def clean(df: DataFrame) -> DataFrame:
    """Without internal columns: ``_id`` and those that begin with ``@``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != "_id" and not c.startswith("@")])
