"""Semantics switches.

Two presets: ``REFERENCE`` reproduces the original notebook's arithmetic, quirks included, and
``CORRECTED`` (the default) fixes the points where that arithmetic leaks the future or divides by the
wrong count. Each switch is independent; see the README for what each one changes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from weekcast.constants import SEASON


@dataclass(frozen=True)
class Preset:
    #: rows per seasonal cycle ("one year")
    season: int = SEASON
    #: signed difference ``total - level``; False keeps ``abs(total - level)``
    signed: bool = True
    #: "positive": warm-up rows are those whose defaulted-to-0 lag is not > 0 (a true 0 also drops);
    #: "index": the first rows of each series, by position
    warmup: str = "index"
    #: value of the label past the end of the series; None keeps it null and unscored
    label_fill: float | None = None
    #: "origin": add back the level of the row the forecast is made at; "target": of the row forecast
    level_at: str = "target"
    #: sMAPE divides by "scored" rows or by "all" rows including trimmed / unforecast ones
    denominator: str = "scored"
    #: SMA window order: "date", or "day" (day of month, date as tie-break)
    sma_order: str = "date"
    #: the SMA window may reach back before the scored rows (the past is known); False keeps it inside
    #: them, so the first scored row has no forecast
    sma_history: bool = True
    #: baseline scored on the models' test target dates ("model_test") or on the last rows of the
    #: weekly series ("series_tail")
    baseline_dates: str = "model_test"
    #: rolling CV origin: "expanding" blocks, or "fixed" (first n % 10 rows always train)
    cv_origin: str = "expanding"
    #: chronological split size: exact decimal ``ceil(n * pct)``; False uses double arithmetic
    exact_split: bool = True
    #: linear penalties as 32-bit floats, the width the original parses them to
    single_penalties: bool = False
    #: linear fits with an L1 part at the optimum (``plans.linear``); False takes what MLlib's iterations reach
    exact_elastic_net: bool = True
    #: seed passed to every randomised estimator
    seed: int = 42

    def with_(self, **changes) -> "Preset":
        return replace(self, **changes)


CORRECTED = Preset()

REFERENCE = Preset(
    signed=False,
    warmup="positive",
    label_fill=0.0,
    level_at="origin",
    denominator="all",
    sma_order="day",
    sma_history=False,
    baseline_dates="series_tail",
    cv_origin="fixed",
    exact_split=False,
    single_penalties=True,
    exact_elastic_net=False,
)

PRESETS = {"reference": REFERENCE, "corrected": CORRECTED}
