"""Seasonal differencing and horizon features (inventory B1-B8, E1-E7, H5, I3-I6).

Every window is ``partitionBy(series keys).orderBy(date)``: after the weekly roll-up a partition holds
one series, at most one row per period, so its size is bounded by the calendar, not by the data
volume. All window steps share that one spec, so the whole builder costs one exchange and one sort;
the filters between steps (S3) are pipelined passes over the already sorted partitions.

Steps, in the order that fixes the answer (S3):

    level (lag by one season) -> warm-up filter -> difference
    -> lags h .. h+3 of the difference -> warm-up filter
    -> moving mean / sample deviation of lag h over k+1 rows, k = h .. h+3 -> warm-up filter
    -> label = difference h rows ahead -> drop rows with nulls
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from weekcast.config import CORRECTED, Preset
from weekcast.constants import N_LAGS
from weekcast.functions.columns import period_suffix



def series_window(keys: Sequence[str] = (), date: str = "date") -> WindowSpec:
    """Rows of a series in time order. Without keys all rows are one series in one task: only for frames
    after the weekly roll-up, which hold one row per period."""
    keys = list(keys)
    return Window.partitionBy(*keys).orderBy(date) if keys else Window.orderBy(date)


def lag_name(k: int) -> str:
    return f"lag_{period_suffix(k)}"


def ma_name(k: int) -> str:
    return f"ma_{period_suffix(k)}"


def std_name(k: int) -> str:
    return f"std_{period_suffix(k)}"


def feature_names(h: int, n_lags: int = N_LAGS) -> list[str]:
    ks = range(h, h + n_lags)
    return [lag_name(k) for k in ks] + [ma_name(k) for k in ks] + [std_name(k) for k in ks]


def _positive(preset: Preset) -> bool:
    if preset.warmup not in ("positive", "index"):
        raise ValueError(f"warmup must be 'positive' or 'index', not {preset.warmup!r}")
    return preset.warmup == "positive"


def seasonal_diff(
    panel: DataFrame,
    keys: Sequence[str] = (),
    preset: Preset = CORRECTED,
    h: int | None = None,
    target: str = "total_sales",
    date: str = "date",
) -> DataFrame:
    """Adds ``lag_1year`` (the value one season back), drops warm-up rows, adds ``diff_sales``. In
    ``index`` mode the row position ``_ix`` is kept for the warm-up steps that follow; a panel that brings its own
    ``_ix`` (a part of a series, see ``ranges``) keeps it.

    With ``h`` given, also adds ``level``: the seasonal level to add back to a forecast made h rows
    ahead. ``level_at="origin"`` takes this row's level (the original); ``"target"`` takes the level of
    the forecast row, ``target`` at ``t + h - season``, which is already known at ``t``.
    """
    w = series_window(keys, date)
    season = preset.season
    positive = _positive(preset)
    cols = {"lag_1year": F.lag(target, season, 0).over(w) if positive else F.lag(target, season).over(w)}
    if not positive and "_ix" not in panel.columns:
        cols["_ix"] = F.row_number().over(w)
    if h is not None and preset.level_at == "target":
        if h >= season:
            raise ValueError("horizon must be shorter than the season")
        cols["level"] = F.lag(target, season - h).over(w)
    df = panel.withColumns(cols)
    df = df.where(F.col("lag_1year") > 0) if positive else df.where(F.col("_ix") > season)
    diff = F.col(target) - F.col("lag_1year")
    df = df.withColumn("diff_sales", diff if preset.signed else F.abs(diff))
    if h is not None and preset.level_at == "origin":
        df = df.withColumn("level", F.col("lag_1year"))
    elif h is not None and preset.level_at != "target":
        raise ValueError(f"level_at must be 'origin' or 'target', not {preset.level_at!r}")
    return df


def lag_features(
    df: DataFrame,
    h: int,
    keys: Sequence[str] = (),
    preset: Preset = CORRECTED,
    n_lags: int = N_LAGS,
    source: str = "diff_sales",
    date: str = "date",
) -> DataFrame:
    """Lags ``h .. h+n_lags-1`` of the difference, then the warm-up filter on the oldest lag."""
    w = series_window(keys, date)
    positive = _positive(preset)
    ks = range(h, h + n_lags)
    df = df.withColumns({lag_name(k): F.lag(source, k, 0 if positive else None).over(w) for k in ks})
    oldest = lag_name(h + n_lags - 1)
    if positive:
        return df.where(F.col(oldest) > 0)
    if "_ix" in df.columns:      # positions of the series before the seasonal cut
        return df.where(F.col("_ix") > preset.season + h + n_lags - 1)
    return df.where(F.col(oldest).isNotNull())


def rolling_stats(
    df: DataFrame,
    h: int,
    keys: Sequence[str] = (),
    preset: Preset = CORRECTED,
    n_lags: int = N_LAGS,
    date: str = "date",
) -> DataFrame:
    """Mean and sample deviation of lag ``h`` over the trailing ``k + 1`` rows, ``k = h .. h+n_lags-1``
    (S4), then drop rows whose widest deviation is not defined (a one-row frame, S5) or, in the
    original's ``positive`` mode, not > 0."""
    base = lag_name(h)
    w = series_window(keys, date)
    cols = {}
    ks = range(h, h + n_lags)
    for k in ks:
        cols[ma_name(k)] = F.avg(base).over(w.rowsBetween(-k, 0))
    for k in ks:
        cols[std_name(k)] = F.stddev_samp(base).over(w.rowsBetween(-k, 0))
    df = df.withColumns(cols)
    widest = F.col(std_name(h + n_lags - 1))
    return df.where(widest > 0) if _positive(preset) else df.where(widest.isNotNull())


def horizon_label(
    df: DataFrame,
    h: int,
    keys: Sequence[str] = (),
    preset: Preset = CORRECTED,
    source: str = "diff_sales",
    date: str = "date",
) -> DataFrame:
    """``label`` = the difference ``h`` rows ahead. Past the end it is ``preset.label_fill``: 0 in the
    original (those rows then look like real targets, S6), null by default."""
    w = series_window(keys, date)
    return df.withColumn("label", F.lead(source, h, preset.label_fill).over(w))


def build_features(
    panel: DataFrame,
    h: int,
    keys: Sequence[str] = (),
    preset: Preset = CORRECTED,
    n_lags: int = N_LAGS,
    target: str = "total_sales",
    date: str = "date",
) -> DataFrame:
    """Feature frame for horizon ``h`` from a weekly panel.

    Columns: series keys, date, the panel's other columns (covariates, month, day), label,
    diff_sales, the lags, moving means and deviations, and ``level`` (the seasonal level that turns a
    forecast of the difference back into a forecast of ``target``). Rows with a null anywhere are
    dropped, except that a null label (past the series end) is kept when ``label_fill`` is None.
    """
    keys = list(keys)
    df = seasonal_diff(panel, keys, preset, h=h, target=target, date=date)
    df = lag_features(df, h, keys, preset, n_lags, date=date)
    df = rolling_stats(df, h, keys, preset, n_lags, date=date)
    df = horizon_label(df, h, keys, preset, date=date)
    carried = [c for c in panel.columns if c not in keys and c not in (date, target)]
    ordered = [*keys, date, *carried, "label", "diff_sales", *feature_names(h, n_lags), "level"]
    df = df.select(*ordered)
    if preset.label_fill is None:
        return df.na.drop(subset=[c for c in ordered if c != "label"])
    return df.na.drop()
