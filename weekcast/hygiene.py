"""Output rounding shared by the Spark queries and their SQL twins.

Sums and window statistics are evaluated in a different order by another engine, so doubles are
compared after rounding: small ratios (covariate means, shares, slopes) to 10 digits, sales-sized
values to 2, scores to 4. The digits are chosen so that the last-bit noise of a ~1e8 value is at least
four orders of magnitude below the rounding step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL = frozenset({"temp", "cpi", "is_holiday", "slope", "importance", "acctbal_share"})
FOUR = frozenset({"smape", "mean_score", "score", "1 week", "2 weeks", "3 weeks"})


def digits_for(name: str) -> int:
    if name in SMALL:
        return 10
    if name in FOUR:
        return 4
    return 2


def tidy(df: DataFrame) -> DataFrame:
    """Round every double column by the rule above; decimals become doubles; other types are kept."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(F.round(F.col(f.name).cast(T.DoubleType()), digits_for(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def sql_round(name: str) -> str:
    return f"ROUND(CAST({name} AS DOUBLE), {digits_for(name)}) AS {name}"
