"""Functions of binary formats that the JVM does not have, as Arrow-batched functions of whole columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..codec import names


@F.pandas_udf(T.StringType())
def name_text(n: pd.Series) -> pd.Series:
    """The text of packed names given as longs (their bits)."""
    return n.map(lambda x: None if pd.isna(x) else names.name_to_text(int(x) & (1 << 64) - 1))


@F.pandas_udf(T.DecimalType(20, 0))
def name_number(s: pd.Series) -> pd.Series:
    from decimal import Decimal

    return s.map(lambda x: None if x is None else Decimal(names.text_to_name(x)))


@F.pandas_udf(T.StringType())
def legacy_key(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else names.k1_to_legacy(x))


@F.pandas_udf(T.DecimalType(20, 0))
def fnv1a64(s: pd.Series) -> pd.Series:
    from decimal import Decimal

    return s.map(lambda x: None if x is None else Decimal(names.fnv1a64(x.encode())))
