"""Made-up events for the live store, by the row number alone, so that any part of them can be made anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares of a hundred: mints, transfers, burns, data changes.
SHARES = (("mint", 35), ("transfer", 45), ("burn", 12), ("setdata", 8))


def made_events(spark: SparkSession, n: int, assets: int, owners: int = 1000, seed: int = 1, first_block: int = 1, per_block: int = 10, parts: int = 8) -> DataFrame:
    """``n`` events on ids below ``assets``, the low ones far oftener (a density that falls with the square root); mints have new
    ids. Columns are those of the live store."""
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    upto, op, hundredth = 0, None, draw("op") * 100
    for name, share in SHARES:
        upto += share
        op = F.when(hundredth < upto, name) if op is None else op.when(hundredth < upto, name)
    mint = F.col("op") == "mint"
    e = spark.range(0, n, 1, parts).withColumn("op", op)
    old = F.floor(draw("asset") * draw("asset") * assets).cast("long")
    return e.select(
        F.when(mint, F.col("id") + assets).otherwise(old).alias("asset_id"), (F.floor(F.col("id") / per_block) + first_block).cast("long").alias("block"), (F.col("id") % per_block).alias("pos"), "op",
        F.when(F.col("op").isin("mint", "transfer"), F.concat(F.lit("owner"), F.floor(draw("owner") * owners).cast("string"))).alias("owner"),
        F.when(F.col("op").isin("mint", "setdata"), F.concat(F.lit("kind"), F.floor(draw("data") * 6).cast("string"))).alias("data"),
        F.when(mint, F.floor(draw("template") * 100).cast("long")).alias("template"),
    )
