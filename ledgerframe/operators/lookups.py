"""Keyed lookups: order-preserving hydration, assembly from several sources, reverse indexes, merges of versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hydrate(requests: DataFrame, rows: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """Every request in its order with the row of its key, and whether there is one. ``rows`` has unique keys."""
    found = rows.withColumn("_hit", F.lit(True))
    return requests.join(found, keys, "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit").orderBy(position)


def reverse_index(df: DataFrame, key: str, value: str, name: str = "members") -> DataFrame:
    """Key to its sorted distinct values, and their number."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name)).withColumn("n", F.size(name))


def assemble(keys: DataFrame, key: str, sources: dict[str, DataFrame]) -> DataFrame:
    """Left joins of sources that each have at most one row for a key; a struct for each, null where absent."""
    def one(left: DataFrame, item) -> DataFrame:
        name, df = item
        values = [c for c in df.columns if c != key]
        return left.join(df.select(key, F.struct(*values).alias(name)), key, "left")

    return reduce(one, sources.items(), keys)


def all_keys(key: str, *sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [s.select(key) for s in sources]).distinct()


def overlay_merge(base: DataFrame, overlay: DataFrame, key: list[str], values: list[str], deleted: str | None = None) -> DataFrame:
    """Base and overlay rows by key; the overlay wins, and takes rows away where ``deleted`` is true."""
    o = overlay.select(*key, F.struct(*values, *([deleted] if deleted else [])).alias("_o"))
    b = base.select(*key, F.struct(*values).alias("_b"))
    merged = b.join(o, key, "full_outer")
    if deleted:
        merged = merged.filter(F.col("_o").isNull() | ~F.coalesce(F.col(f"_o.{deleted}"), F.lit(False)))
    return merged.select(*key, *[F.when(F.col("_o").isNotNull(), F.col(f"_o.{v}")).otherwise(F.col(f"_b.{v}")).alias(v) for v in values], F.col("_o").isNotNull().alias("from_overlay"))


def select_targets(targets: list[tuple[Column, ...]]) -> Column:
    """OR of ANDed conditions; no target selects nothing."""
    return reduce(lambda a, b: a | b, [reduce(lambda x, y: x & y, t) for t in targets], F.lit(False))


def effective_set(base: DataFrame, add: DataFrame, remove: DataFrame, tombs: DataFrame, key: str) -> DataFrame:
    """(base and additions) without removals and tombs."""
    live = base.select(key).union(add.select(key)).distinct()
    return live.join(remove.select(key), key, "left_anti").join(tombs.select(key), key, "left_anti")


def unpivot_counts(df: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """Rows of every value of several dimensions, in one aggregation."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), c.cast("string").alias("key")) for d, c in dims.items()])
    return df.select(F.explode(pairs).alias("x")).groupBy("x.dim", "x.key").agg(F.count("*").alias("n"))


def fan_out(networks: dict[str, DataFrame], question, name: str = "network") -> DataFrame:
    """The answers of all networks to one question (a function of their rows), each with its network's name."""
    return reduce(DataFrame.unionByName, [question(df).select(F.lit(n).alias(name), "*") for n, df in networks.items()])
