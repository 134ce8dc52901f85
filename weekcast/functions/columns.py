"""Column expressions shared by the operators. All built-in Spark functions: they stay inside
whole-stage codegen, and none of them raises under ANSI mode on dirty input."""

from __future__ import annotations

from weekcast.constants import DATE_FORMAT

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: str | Column) -> Column:
    """Text numbers with ``NA`` (or any junk) as null doubles; numeric input passes through."""
    return col_(c).try_cast(T.DoubleType())


def parse_date(c: str | Column, fmt: str = DATE_FORMAT) -> Column:
    """Text date to DATE; unparseable text becomes null instead of failing the job under ANSI."""
    return F.try_to_date(col_(c), fmt)


def holiday_flag(c: str | Column, true_values: Sequence[str] = ("true", "1"), normalize: bool = True) -> Column:
    """0/1 integer flag. With ``normalize`` the text is trimmed and lower-cased first, so boolean
    ``true``, text ``TRUE`` and ``True`` all count; without it only the exact values do."""
    text = col_(c).cast(T.StringType())
    if normalize:
        text = F.lower(F.trim(text))
        values = [v.lower() for v in true_values]
    else:
        values = list(true_values)
    return F.when(text.isin(values), F.lit(1)).otherwise(F.lit(0)).cast(T.IntegerType())


def period_suffix(k: int, unit: str = "week") -> str:
    """``1week``, ``2weeks`` ... as in the feature names of the original frames."""
    return f"{k}{unit}" if k == 1 else f"{k}{unit}s"


def smape_term(prediction: str | Column, actual: str | Column) -> Column:
    """``|p - a| / ((|p| + |a|) / 2)``; null when both are 0 (no division error under ANSI)."""
    p, a = col_(prediction), col_(actual)
    return F.try_divide(F.abs(p - a), (F.abs(p) + F.abs(a)) / F.lit(2.0))
