"""Scores, retrend and the moving-average baseline (inventory C3, D5, D6, E8, H6, H7, I16-I18, I23).

Every score is a DataFrame aggregate (one row per series, or one row), computed where the data is;
only the caller decides whether a scalar ever goes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.config import CORRECTED, Preset
from weekcast.constants import SPLIT_PCT
from weekcast.functions.columns import smape_term
from weekcast.operators.split import TEST, split_frame


def retrend(pred: DataFrame, level: str = "level", columns: Sequence[str] = ("prediction", "label")) -> DataFrame:
    """Add the seasonal level back to forecast and actual. The level travels with the row, so no
    positional join is needed (C3, S13, S14)."""
    return pred.withColumns({c: F.col(c) + F.col(level) for c in columns})


def retrend_by_join(
    pred: DataFrame, levels: DataFrame, keys: Sequence[str] = (), date: str = "date", level: str = "level"
) -> DataFrame:
    """Retrend when the levels live in their own frame: an equi-join on (series keys, date), which
    is what the original's row-id join meant. Both sides are one row per (series, date); a null key or date
    is a value like any other."""
    return retrend(left_by_key(pred, levels.select(*keys, date, level), [*keys, date]), level)


def left_by_key(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on null-safe equality of the ``on`` columns, which the result has once."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(named, same, "left").drop(*[f"_r_{c}" for c in on])


def rmse(
    pred: DataFrame, keys: Sequence[str] = (), prediction: str = "prediction", label: str = "label"
) -> DataFrame:
    """Root mean squared error over rows with both a forecast and an actual."""
    scored = pred.where(F.col(prediction).isNotNull() & F.col(label).isNotNull())
    return scored.groupBy(*keys).agg(
        F.sqrt(F.avg(F.pow(F.col(prediction) - F.col(label), 2))).alias("rmse"),
        F.count(F.lit(1)).alias("n"),
    )


def smape(
    pred: DataFrame,
    trim_last: int | Column = 0,
    keys: Sequence[str] = (),
    preset: Preset = CORRECTED,
    prediction: str = "prediction",
    label: str = "label",
    date: str = "date",
    digits: int | None = 4,
) -> DataFrame:
    """sMAPE in percent: ``100 / n * sum(|p - a| / ((|p| + |a|) / 2))``.

    The last ``trim_last`` rows of each series (by date; a number or a column) are not scored; without keys that takes a window over
    one series, which is bounded by the calendar. ``denominator="all"`` divides
    by every row, trimmed and unforecast ones included, as the original does (S8); ``"scored"``
    divides by the rows that were scored. A 0/0 term counts as 0.
    """
    if preset.denominator not in ("all", "scored"):
        raise ValueError(f"denominator must be 'all' or 'scored', not {preset.denominator!r}")
    df = pred
    if isinstance(trim_last, Column) or trim_last:
        from_end = Window.partitionBy(*keys).orderBy(F.col(date).desc()) if keys else Window.orderBy(F.col(date).desc())
        df = df.withColumn("_from_end", F.row_number().over(from_end))
        kept = F.col("_from_end") > (trim_last if isinstance(trim_last, Column) else F.lit(trim_last))
    else:
        kept = F.lit(True)
    scored = kept & F.col(prediction).isNotNull() & F.col(label).isNotNull()
    term = F.when(scored, F.coalesce(smape_term(prediction, label), F.lit(0.0)))
    n = F.count(F.lit(1)) if preset.denominator == "all" else F.count(term)
    value = F.try_divide(F.sum(term), n) * F.lit(100.0)
    if digits is not None:
        value = F.round(value, digits)
    return df.groupBy(*keys).agg(value.cast(T.DoubleType()).alias("smape"), F.count(term).alias("n_scored"))


def sma_forecast(
    df: DataFrame,
    window: int,
    keys: Sequence[str] = (),
    preset: Preset = CORRECTED,
    target: str = "total_sales",
    date: str = "date",
    name: str = "sma",
) -> DataFrame:
    """Mean of the previous ``window`` rows (the current row excluded), in date order; the original
    orders by day of month (S9), kept with ``sma_order="day"`` and date as the tie-break. Without keys the
    window holds one weekly series in one task."""
    if preset.sma_order == "day":
        order = [F.dayofmonth(date), F.col(date)]
    elif preset.sma_order == "date":
        order = [F.col(date)]
    else:
        raise ValueError(f"sma_order must be 'date' or 'day', not {preset.sma_order!r}")
    spec = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn(name, F.avg(target).over(spec.rowsBetween(-window, -1)))


def sma_test_frame(
    weekly: DataFrame,
    window: int,
    pct: float = SPLIT_PCT,
    keys: Sequence[str] = (),
    preset: Preset = CORRECTED,
    target: str = "total_sales",
    date: str = "date",
) -> DataFrame:
    """Baseline forecasts on the last ``1 - pct`` of the weekly series, as ``prediction`` / ``label``.

    ``sma_history=False`` (the original): the window sees only test rows, so the first has no forecast.
    Default: the window runs over the whole series (the past is known at forecast time) and only test
    rows are kept.
    """
    s = split_frame(weekly, pct, 0, keys, preset, date)
    if not preset.sma_history:
        test = s.where(F.col("role") == TEST)
        out = sma_forecast(test, window, keys, preset, target, date, "prediction")
    else:
        out = sma_forecast(s, window, keys, preset, target, date, "prediction").where(F.col("role") == TEST)
    return out.select(*keys, date, F.col(target).alias("label"), "prediction")


def sma_smape(
    weekly: DataFrame,
    window: int,
    pct: float = SPLIT_PCT,
    keys: Sequence[str] = (),
    preset: Preset = CORRECTED,
    target: str = "total_sales",
    date: str = "date",
) -> DataFrame:
    """sMAPE of the moving-average baseline."""
    return smape(sma_test_frame(weekly, window, pct, keys, preset, target, date), 0, keys, preset, date=date)
