"""Chronological split, purge gap and rolling folds (inventory B7, E9, F1, F2, H9, I7-I9, I20).

Positions come from ``row_number`` over (series keys) ordered by date and sizes from a ``count`` over the
same partition, so a split is one window pass with no driver round trip and no global sort; with
keys, every series is split in its own time order. ``monotonically_increasing_id`` is never used as a
position (S13).
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.config import CORRECTED, Preset
from weekcast.constants import CV_FIXED_MODULUS, N_LAGS, SPLIT_PCT
from weekcast.operators.features import series_window

TRAIN, GAP, TEST = "train", "gap", "test"


def purge_gap(h: int, n_lags: int = N_LAGS) -> int:
    """Rows dropped from the end of train: the oldest lag plus the lead, ``(h + n_lags - 1) + h``."""
    return (h + n_lags - 1) + h


def split_size(n: Column, pct: float, exact: bool = True) -> Column:
    """``ceil(n * pct)`` rows. Exact decimal arithmetic by default; ``exact=False`` uses doubles as the
    original does, which can round up one more row when ``n * pct`` is a whole number."""
    if exact:
        return F.ceil(n * F.lit(Decimal(str(pct)))).cast(T.LongType())
    return F.ceil(n.cast(T.DoubleType()) * F.lit(float(pct))).cast(T.LongType())


def split_frame(
    df: DataFrame,
    pct: float = SPLIT_PCT,
    gap: int = 0,
    keys: Sequence[str] = (),
    preset: Preset = CORRECTED,
    date: str = "date",
) -> DataFrame:
    """Adds ``row_ix``, ``n_rows``, ``cut`` and ``role``: ``train`` for the first ``cut - gap`` rows,
    ``gap`` for the purged rows up to ``cut``, ``test`` for the rest. ``cut = ceil(n_rows * pct)``."""
    w = series_window(keys, date)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({"row_ix": F.row_number().over(w).cast(T.LongType()), "n_rows": F.count(F.lit(1)).over(whole)})
    return with_roles(df, pct, gap, preset)


def with_roles(df: DataFrame, pct: float, gap: int, preset: Preset) -> DataFrame:
    """Adds ``cut`` and ``role`` to rows that know their position ``row_ix`` of ``n_rows``."""
    df = df.withColumn("cut", split_size(F.col("n_rows"), pct, preset.exact_split))
    role = (
        F.when(F.col("row_ix") <= F.col("cut") - F.lit(gap), F.lit(TRAIN))
        .when(F.col("row_ix") <= F.col("cut"), F.lit(GAP))
        .otherwise(F.lit(TEST))
    )
    return df.withColumn("role", role)


def ts_split(
    df: DataFrame, pct: float = SPLIT_PCT, keys: Sequence[str] = (), preset: Preset = CORRECTED, date: str = "date"
) -> tuple[DataFrame, DataFrame]:
    """``(first ceil(n * pct) rows, the rest)`` per series, in time order."""
    s = split_frame(df, pct, 0, keys, preset, date)
    drop = ("row_ix", "n_rows", "cut", "role")
    return s.where(F.col("role") == TRAIN).drop(*drop), s.where(F.col("role") == TEST).drop(*drop)


def _fold_bounds(n: Column, fold: Column, folds: int, origin: str) -> tuple[Column, Column]:
    """(last train position before any gap, last test position) of ``fold`` (1-based)."""
    if origin == "expanding":
        # folds + 1 blocks of (almost) equal size; fold i trains on blocks 1..i, tests block i + 1
        blocks = F.lit(folds + 1)
        train_end = F.floor(fold * n / blocks).cast(T.LongType())
        test_end = F.floor((fold + 1) * n / blocks).cast(T.LongType())
        return train_end, test_end
    if origin == "fixed":
        # the original: the first n % 10 rows always train, the test part grows by equal shifts, and the
        # train share initial / total is a 32-bit float (the rounding decides the cut, S10, S11)
        initial = n % F.lit(CV_FIXED_MODULUS)
        shift = F.floor((n - initial) / F.lit(folds)).cast(T.LongType())
        total = initial + shift * fold
        share = (initial.cast(T.DoubleType()) / total.cast(T.DoubleType())).cast(T.FloatType())
        train_end = F.ceil(total.cast(T.DoubleType()) * share.cast(T.DoubleType())).cast(T.LongType())
        return train_end, total
    raise ValueError(f"origin must be 'expanding' or 'fixed', not {origin!r}")


def rolling_folds(
    df: DataFrame,
    folds: int = 2,
    gap: int = 0,
    keys: Sequence[str] = (),
    preset: Preset = CORRECTED,
    date: str = "date",
) -> DataFrame:
    """Long frame of CV assignments: every row once per fold it takes part in, with ``fold`` (1-based),
    ``role`` (``train`` / ``test``), ``row_ix`` and ``n_rows``.

    ``expanding`` (default): fold i trains on the first i of ``folds + 1`` blocks less ``gap`` rows and
    tests the next block, so train always precedes test and the origin moves forward.
    ``fixed`` (the original): train is always the first ``n % 10`` rows (one more when the float
    share rounds up), test the next ``i * shift`` rows; no gap.

    Rows are repeated at most ``folds`` times (an ``explode`` over a literal array), never paired.
    """
    w = series_window(keys, date)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = df.withColumns({"row_ix": F.row_number().over(w).cast(T.LongType()),
                           "n_rows": F.count(F.lit(1)).over(whole)})
    base = base.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(1, folds + 1)])))
    train_end, test_end = _fold_bounds(F.col("n_rows"), F.col("fold"), folds, preset.cv_origin)
    fold_gap = gap if preset.cv_origin == "expanding" else 0
    ix = F.col("row_ix")
    role = (
        F.when(ix <= train_end - F.lit(fold_gap), F.lit(TRAIN))
        .when((ix > train_end) & (ix <= test_end), F.lit(TEST))
    )
    return base.withColumn("role", role).where(F.col("role").isNotNull())


def fold_summary(folds_df: DataFrame, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """``(keys, fold, role, n, first_date, last_date)`` per fold and role."""
    return folds_df.groupBy(*keys, "fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )
