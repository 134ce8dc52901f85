"""Features of a date range from the facts they need (inventory B6, B7).

The original builds the whole series and filters afterwards. Here the asked range is widened by the rows that its
features reach, the facts are read for that range only, and what was added is trimmed after the windows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekcast.config import CORRECTED, Preset
from weekcast.constants import N_LAGS
from weekcast.operators.features import build_features
from weekcast.operators.ranges import needs_positions, feature_halo

Dates = tuple[dt.date, dt.date]


def _nth(dates: Column, n: int, ascending: bool) -> Column:
    """The n-th of a set of dates in order; null if there are fewer."""
    return F.get(F.sort_array(dates, asc=ascending), F.lit(n - 1))


def widened(calendar: DataFrame, between: Dates, before: int, after: int, keys: Sequence[str] = (), date: str = "date") -> Dates:
    """The least range of dates that gives every series its ``before`` rows in front of ``between`` and its
    ``after`` rows behind it, or all it has there.

    ``calendar`` has the dates of each series, repeated or not; the calendar bounds what is held for one. Rows, not
    periods, are counted, so gaps in a series widen the range."""
    start, end = (F.lit(d) for d in between)
    earlier = F.collect_set(F.when(F.col(date) < start, F.col(date)))
    later = F.collect_set(F.when(F.col(date) > end, F.col(date)))
    reach = calendar.where(F.col(date).isNotNull()).groupBy(*keys).agg(
        F.least(start, _nth(earlier, before, False) if before else start, F.when(F.size(earlier) < before, F.min(date))).alias("lo"),
        F.greatest(end, _nth(later, after, True) if after else end, F.when(F.size(later) < after, F.max(date))).alias("hi"))
    row = reach.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    return (row["lo"], row["hi"]) if row["lo"] is not None else between


def reach(h: int, preset: Preset = CORRECTED, n_lags: int = N_LAGS) -> tuple[int, int]:
    """Rows in front of a date range and behind it that its features need. In front: ``feature_halo``, and so many
    that the rows of the widest moving frame are past the warm-up, which is counted from the first row read."""
    before, after = feature_halo(h, preset, n_lags)
    return max(before, preset.season + 2 * (h + n_lags - 1)), after


def features_between(calendar: DataFrame, panel_of: Callable[[dt.date, dt.date], DataFrame], between: Dates, h: int,
                     keys: Sequence[str] = (), preset: Preset = CORRECTED, n_lags: int = N_LAGS,
                     target: str = "total_sales", date: str = "date") -> DataFrame:
    """``build_features`` for the dates ``between`` (both included), equal to building everything and filtering.

    ``panel_of(lo, hi)`` gives the weekly panel of the facts dated from ``lo`` to ``hi``; it should filter the
    column that the files hold, so that the scan skips the rest. A series that begins within the widened range
    has its true first row there, so positions from its start hold; of one that begins before, every row that the
    range sees is past the warm-up (``reach``)."""
    needs_positions(preset)
    lo, hi = widened(calendar, between, *reach(h, preset, n_lags), keys, date)
    built = build_features(panel_of(lo, hi), h, keys, preset, n_lags, target, date)
    return built.where(F.col(date).between(*(F.lit(d) for d in between)))
