"""Staking buckets by maturity, in base units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fixed_rate


def split(buckets: DataFrame, account: str, units: str, matures: str, now, savings_from, lendable: int, total: int) -> DataFrame:
    """Matured (due by ``now``), savings (due from ``savings_from``) and maturing units of each account, summed first and then
    converted at lendable / total, truncated toward zero; 0 without a pool."""
    due, u = F.col(matures), F.col(units)
    savings, matured = due >= F.lit(savings_from), due <= F.lit(now)
    kinds = {"matured": matured & ~savings, "maturing": ~matured & ~savings, "savings": savings}
    sums = buckets.groupBy(account).agg(*[F.coalesce(F.sum(F.when(c, u)), F.lit(0)).cast("decimal(38,0)").alias(k) for k, c in kinds.items()])
    return sums.select(account, *[fixed_rate(F.col(k), F.lit(lendable), F.lit(total)).alias(k) for k in kinds])
