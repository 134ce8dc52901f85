"""Positions, splits and windows of one long series in parallel (inventory E1-E9, B7, F2, I7).

Without series keys a window gathers all rows in one task. That is fine for a weekly series, whose calendar bounds
it; for raw-grain rows, or a long series, the functions here do the same by ranges:

* ``positions``: rows are dealt to ranges of their order and sorted within each; a row's position is its place in
  its range plus the rows of the ranges before it. Only the count of each range meets in one place.
* ``over_ranges``: a range brings a halo of the rows before and after it that its windows reach, the windows run per
  range, and the halo is dropped. A row is copied into a neighbour only where it is within the halo.

Rows that are equal in every ordering column take neighbouring positions in no fixed order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.config import CORRECTED, Preset
from weekcast.constants import N_LAGS, SPLIT_PCT
from weekcast.operators.evaluate import sma_forecast
from weekcast.operators.features import build_features
from weekcast.operators.split import TEST, TRAIN, with_roles
from weekcast.session import materialize

#: Rows of a range; the halo is copied once for each, so a range should be many times as long.
RANGE_ROWS = 1 << 16


def positions(df: DataFrame, order: Sequence[str] = ("date",), name: str = "row_ix", total: str = "n_rows") -> DataFrame:
    """Adds the 1-based position of every row in the order of ``order`` (nulls first) and the number of rows.

    The ordered rows are materialized (see ``session.materialize``), as ranges are drawn from a sample and both
    readings must see the same ones; ``order`` should tell rows apart, so that a date with very many rows is split."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialize(ranged)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row for each range, whatever the rows
    counts = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, rows = [], 0
    for r in counts:
        before.append((r["part"], rows))
        rows += r["n"]
    first = df.sparkSession.createDataFrame(before, "_part long, _before long")
    placed = ranged.withColumn("_part", part).join(F.broadcast(first), "_part")
    out = placed.withColumns({name: F.col("_before") + place + 1, total: F.lit(rows).cast(T.LongType())})
    return out.drop("_at", "_part", "_before")


def split_by_ranges(df: DataFrame, pct: float = SPLIT_PCT, gap: int = 0, order: Sequence[str] = ("date",),
                    preset: Preset = CORRECTED) -> DataFrame:
    """``split.split_frame`` of one series, without a window: ``row_ix``, ``n_rows``, ``cut`` and ``role``."""
    return with_roles(positions(df, order), pct, gap, preset)


def ts_split_by_ranges(df: DataFrame, pct: float = SPLIT_PCT, order: Sequence[str] = ("date",),
                       preset: Preset = CORRECTED) -> tuple[DataFrame, DataFrame]:
    """``split.ts_split`` of one series: ``(first ceil(n * pct) rows, the rest)``."""
    s = split_by_ranges(df, pct, 0, order, preset)
    drop = ("row_ix", "n_rows", "cut", "role")
    return s.where(F.col("role") == TRAIN).drop(*drop), s.where(F.col("role") == TEST).drop(*drop)


def over_ranges(df: DataFrame, before: int, after: int, windows: Callable[[DataFrame, tuple[str, ...]], DataFrame],
                order: Sequence[str] = ("date",), rows: int = RANGE_ROWS) -> DataFrame:
    """``windows(frame, keys)`` over ranges of ``rows`` rows, as if over the whole series.

    ``windows`` gets each range with up to ``before`` rows in front and ``after`` rows behind it, told apart by the
    series key ``keys``, and the row's position in the whole series as ``_ix``. It may use windows that reach no
    further, and drop rows by ``_ix`` or by columns whose values lie within that reach; it must keep the key and
    ``_ix``."""
    if rows < 1 or before < 0 or after < 0:
        raise ValueError("rows must be positive, before and after not negative")
    placed = positions(df, order, "_ix", "_n")
    place = F.col("_ix") - 1
    block = lambda p: F.floor(p / F.lit(rows)).cast(T.LongType())
    first = F.greatest(block(place - after), F.lit(0).cast(T.LongType()))
    last = F.least(block(place + before), block(F.col("_n") - 1))
    spread = placed.withColumn("_range", F.explode(F.sequence(first, last))).drop("_n")
    out = windows(spread, ("_range",))
    return out.where(F.col("_range") == block(place)).drop("_range", "_ix")


def feature_halo(h: int, preset: Preset = CORRECTED, n_lags: int = N_LAGS) -> tuple[int, int]:
    """Rows that the features of a row reach, before and after it: the widest deviation sees lag ``h`` of the row
    ``h + n_lags - 1`` back, whose difference is against the row one season before; the label is ``h`` ahead."""
    return preset.season + (h + n_lags - 1) + h, h


def needs_positions(preset: Preset) -> None:
    if preset.warmup != "index":
        raise ValueError("by ranges warm-up rows must be told by position (warmup='index'): rows that values drop "
                         "move all later rows")


def build_features_by_ranges(panel: DataFrame, h: int, preset: Preset = CORRECTED, n_lags: int = N_LAGS,
                             target: str = "total_sales", date: str = "date", rows: int = RANGE_ROWS) -> DataFrame:
    """``features.build_features`` of one series, by ranges of ``rows`` rows."""
    needs_positions(preset)
    before, after = feature_halo(h, preset, n_lags)
    return over_ranges(panel, before, after, lambda part, keys: build_features(part, h, keys, preset, n_lags, target, date), (date,), rows)


def sma_by_ranges(df: DataFrame, window: int, preset: Preset = CORRECTED, target: str = "total_sales", date: str = "date",
                  name: str = "sma", rows: int = RANGE_ROWS) -> DataFrame:
    """``evaluate.sma_forecast`` of one series, by ranges; in date order only."""
    if preset.sma_order != "date":
        raise ValueError("by ranges the moving average runs in date order (sma_order='date')")
    return over_ranges(df, window, 0, lambda part, keys: sma_forecast(part, window, keys, preset, target, date, name), (date,), rows)
