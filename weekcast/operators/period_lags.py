"""Lags by a period index instead of row positions (inventory E2-E4).

A lag of k is the value k periods earlier: an equi-join on index - k. Rows are hashed by (series keys, index), so one
long or hot series spreads over all partitions, no window gathers it, and a missing period gives a null instead of
sliding the lags over the gap.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.config import CORRECTED, Preset
from weekcast.constants import N_LAGS
from weekcast.operators.evaluate import left_by_key
from weekcast.operators.features import lag_name

WEEK_DAYS = 7


def period_index(date: str = "date", step_days: int = WEEK_DAYS) -> Column:
    """Number of the period of ``step_days`` days that a date lies in, counted from Monday 1970-01-05."""
    return F.floor(F.date_diff(F.col(date), F.lit("1970-01-05").cast("date")) / F.lit(step_days)).cast(T.LongType())


def period_lags(df: DataFrame, lags: Mapping[str, tuple[str, int]], keys: Sequence[str] = (), date: str = "date",
                step_days: int = WEEK_DAYS) -> DataFrame:
    """Adds a column for each ``name: (source, k)``: ``source`` of the series' row ``k`` periods earlier (later for a
    negative k), null where that period has no row. Rows without a date have no period and null lags.

    Every row sends its sources once to each period that looks at it; the periods collect them in one grouping,
    which arrives hashed as the join wants it. Fails if a series has two rows in one period."""
    ks = sorted({k for _, k in lags.values()} | {0})
    sources = sorted({s for s, _ in lags.values()})
    base = df.withColumn("_index", period_index(date, step_days))
    shift = F.explode(F.array(*[F.lit(k) for k in ks])).alias("_k")
    sent = base.where(F.col("_index").isNotNull()).select(*keys, "_index", *[F.col(s).alias(f"_s_{s}") for s in sources], shift)
    sent = sent.withColumn("_index", F.col("_index") + F.col("_k"))
    values = [F.first(F.when(F.col("_k") == k, F.col(f"_s_{s}")), ignorenulls=True).alias(name) for name, (s, k) in lags.items()]
    own = F.count(F.when(F.col("_k") == 0, True)).alias("_own")
    seen = sent.groupBy(*keys, "_index").agg(*values, own)
    twice = F.raise_error(F.concat(F.lit("two rows of one series in period "), F.col("_index").cast("string"))).cast(T.BooleanType())
    seen = seen.where(F.when(F.col("_own") > 1, twice).otherwise(F.col("_own") == 1)).drop("_own")
    return left_by_key(base, seen, [*keys, "_index"]).drop("_index")


def features_by_period(panel: DataFrame, h: int, keys: Sequence[str] = (), preset: Preset = CORRECTED, n_lags: int = N_LAGS,
                       target: str = "total_sales", date: str = "date", step_days: int = WEEK_DAYS) -> DataFrame:
    """The level one season back, the difference against it, its lags ``h .. h+n_lags-1`` and the label ``h`` periods
    ahead, all by calendar. No row is dropped: what lies outside the series or in a gap is null."""
    df = period_lags(panel, {"lag_1year": (target, preset.season)}, keys, date, step_days)
    diff = F.col(target) - F.col("lag_1year")
    df = df.withColumn("diff_sales", diff if preset.signed else F.abs(diff))
    wanted = {lag_name(k): ("diff_sales", k) for k in range(h, h + n_lags)} | {"label": ("diff_sales", -h)}
    return period_lags(df, wanted, keys, date, step_days)
