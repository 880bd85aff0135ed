"""State of keyed assets from an event log: mint, transfer, burn and data changes, with rollback and compaction.

Rules for an asset, in the order of (block, pos): a mint creates it, and a mint of a known or burned id is ignored; a
transfer sets owner and block of a live asset unless the owner is the same; a burn is final, even for an unknown id; a data
change replaces the data of a live asset and leaves its block. The state is a pure function of base and log, so a
rollback is the log up to a block, and a compaction writes the state as the next base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current_state(events: DataFrame, base: DataFrame | None = None, upto: int | None = None, key: str = "asset_id") -> DataFrame:
    """Live assets (key, owner, data, template, block). Events: key, block, pos, op (mint, transfer, burn, setdata), owner, data,
    template. The base counts as mints before all events."""
    log = events.select(key, F.col("block").alias("_b"), F.col("pos").alias("_p"), "op", "owner", "data", "template")
    if upto is not None:
        log = log.filter(F.col("_b") <= upto)
    if base is not None:
        first = base.select(key, F.lit(-1).cast("long").alias("_b"), F.lit(0).cast("long").alias("_p"), F.lit("mint").alias("op"), "owner", "data", "template", F.col("block").alias("_block"))
        log = first.unionByName(log.withColumn("_block", F.col("_b")))
    else:
        log = log.withColumn("_block", F.col("_b"))
    order = Window.partitionBy(key).orderBy("_b", "_p")
    born = F.min(F.when(F.col("op") == "mint", F.struct("_b", "_p"))).over(Window.partitionBy(key))
    dead = F.max(F.when(F.col("op") == "burn", 1)).over(Window.partitionBy(key))
    log = log.withColumn("_born", born).withColumn("_dead", dead).filter("_dead is null and _born is not null")
    log = log.filter((F.struct("_b", "_p") > F.col("_born")) & (F.col("op") != "mint") | (F.struct("_b", "_p") == F.col("_born")) & (F.col("op") == "mint"))
    mover = log.filter(F.col("op").isin("mint", "transfer"))
    mover = mover.withColumn("_was", F.lag("owner").over(order)).filter((F.col("op") == "mint") | ~F.col("owner").eqNullSafe(F.col("_was")))
    owned = mover.groupBy(key).agg(F.max_by(F.struct("owner", "_block"), F.struct("_b", "_p")).alias("o"))
    held = log.filter(F.col("op").isin("mint", "setdata")).groupBy(key).agg(F.max_by(F.struct("data"), F.struct("_b", "_p")).alias("d"), F.max(F.when(F.col("op") == "mint", F.col("template"))).alias("template"))
    return owned.join(held, key).select(key, F.col("o.owner").alias("owner"), F.col("d.data").alias("data"), "template", F.col("o._block").alias("block"))


def compact(events: DataFrame, base: DataFrame | None = None, key: str = "asset_id") -> DataFrame:
    """The next base; ordinals within a template are dense again."""
    order = Window.partitionBy("template").orderBy(key)
    return current_state(events, base, key=key).withColumn("ordinal", F.when(F.col("template").isNull(), 0).otherwise(F.row_number().over(order)))


def mint_ordinals(events: DataFrame, base: DataFrame, key: str = "asset_id") -> DataFrame:
    """Ordinals of minted assets: after all base members of the template, burned ones too, in the order of minting."""
    known = base.filter(F.col("template").isNotNull()).groupBy("template").agg(F.count("*").alias("_n"))
    mints = events.filter((F.col("op") == "mint") & F.col("template").isNotNull()).join(base.select(key), key, "left_anti")
    rank = F.row_number().over(Window.partitionBy("template").orderBy("block", "pos"))
    return mints.withColumn("_r", rank).join(known, "template", "left").select(key, "template", (F.coalesce("_n", F.lit(0)) + F.col("_r")).alias("ordinal"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, n, total): rows that one side has more often than the other, and all rows of the side; equal states give 0 and 0."""
    columns = left.columns
    both = left.withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0)).unionByName(right.withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1)))
    per = both.groupBy(*columns).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    more = lambda a, b: F.coalesce(F.sum(F.greatest(F.lit(0), F.col(a) - F.col(b))), F.lit(0))
    sums = per.agg(F.array(F.struct(F.lit("left").alias("side"), more("l", "r").alias("n"), F.coalesce(F.sum("l"), F.lit(0)).alias("total")), F.struct(F.lit("right").alias("side"), more("r", "l").alias("n"), F.coalesce(F.sum("r"), F.lit(0)).alias("total"))).alias("x"))
    return sums.select(F.inline("x"))
