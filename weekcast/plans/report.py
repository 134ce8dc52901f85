"""Model runs and the accuracy comparison (inventory I24-I26, A4, A5).

For each horizon: build the feature frame, split it with the purge gap, pick the inputs by
importance, then for each model either take pinned parameters or tune them by rolling CV, refit on the
whole train part, forecast the test part, add the seasonal level back and score by sMAPE. The
moving-average baseline is scored alongside. Results stay DataFrames; the final table is a pivot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.config import CORRECTED, Preset
from weekcast.operators.evaluate import left_by_key, retrend, sma_smape, smape
from weekcast.operators.features import build_features, series_window
from weekcast.operators.split import TEST, TRAIN, purge_gap, split_frame
from weekcast.plans.models import fit_predict
from weekcast.plans.select import candidate_columns, feature_importance, select_features
from weekcast.constants import CV_FOLDS, MODEL_NAMES, PARAM_GRIDS, PINNED, SMA_WINDOWS, SPLIT_PCT
from weekcast.plans.tune import best_params, in_parallel, rolling_cv
from weekcast.session import materialize, release


@dataclass
class HorizonData:
    h: int
    frame: DataFrame            # feature frame with row_ix / n_rows / cut / role, lineage cut
    features: list[str]         # selected model inputs
    importance: DataFrame | None   # None when the inputs were given

    @property
    def train(self) -> DataFrame:
        return self.frame.where(F.col("role") == TRAIN)

    @property
    def test(self) -> DataFrame:
        return self.frame.where(F.col("role") == TEST)

    def release(self) -> None:
        """Free the materialized frame; what was built on it still evaluates, from lineage if need be."""
        release(self.frame)


@dataclass
class ModelRun:
    model: str
    h: int
    params: dict
    predictions: DataFrame      # keys, date, prediction, label (retrended), level
    score: DataFrame            # keys, smape, n_scored
    cv: DataFrame | None = field(default=None)


def prepare_horizon(
    panel: DataFrame,
    h: int,
    keys: Sequence[str] = (),
    preset: Preset = CORRECTED,
    pct: float = SPLIT_PCT,
    feature_cols: Sequence[str] | None = None,
) -> HorizonData:
    """Feature frame for ``h``, split with the purge gap; inputs are ``feature_cols`` when given, else
    chosen by forest importance on the training rows. With keys, a series enters the one global model through
    its own level and scale (``series_features``)."""
    frame = split_frame(build_features(panel, h, keys, preset), pct, purge_gap(h), keys, preset)
    frame = materialize(series_features(frame, keys) if keys else frame)
    if feature_cols is not None:
        return HorizonData(h, frame, list(feature_cols), None)
    train = frame.where(F.col("role") == TRAIN)
    importance = feature_importance(train, candidate_columns(frame, keys), preset)
    return HorizonData(h, frame, select_features(importance), importance)


def series_features(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``series_mean`` and ``series_std``: mean and deviation of the difference over the training rows
    of the row's own series (0 for a deviation that is not defined). Test rows never enter."""
    own = Window.partitionBy(*keys)
    train = F.when(F.col("role") == TRAIN, F.col("diff_sales"))
    frame = frame.withColumns({"series_mean": F.avg(train).over(own), "series_std": F.stddev_samp(train).over(own)})
    return frame.na.fill(0.0, ["series_mean", "series_std"])


def run_model(
    data: HorizonData,
    name: str,
    params: Mapping[str, object] | None = None,
    grid: Mapping[str, Sequence[object]] | None = None,
    keys: Sequence[str] = (),
    preset: Preset = CORRECTED,
    parallelism: int = 8,
) -> ModelRun:
    """Tune (when ``params`` is None), refit on train, forecast test, retrend, score."""
    cv = None
    if params is None:
        cv = rolling_cv(data.train, data.features, name, grid or PARAM_GRIDS[name], CV_FOLDS,
                        purge_gap(data.h), keys, preset, parallelism=parallelism)
        params = best_params(cv)
    pred = fit_predict(data.train, data.test, data.features, name, params, preset, keep=(*keys, "date", "label", "level"))
    pred = retrend(pred)
    # rows past the series end carry a filled, not a real, label when ``label_fill`` is set: trim them
    trim = data.h if preset.label_fill is not None else 0
    return ModelRun(name, data.h, dict(params), pred, smape(pred, trim, keys, preset), cv)


def sma_on_test(panel: DataFrame, data: HorizonData, window: int, keys: Sequence[str] = (),
                preset: Preset = CORRECTED, target: str = "total_sales") -> DataFrame:
    """Baseline on the models' own test rows: the forecast of ``target`` at ``t + h`` made at ``t`` is the
    mean of the last ``window`` known values up to ``t``. Joined on (keys, date), null keys included: one row
    each side."""
    w = series_window(keys).rowsBetween(-(window - 1), 0)
    sma = panel.select(*keys, "date", F.avg(target).over(w).alias("prediction"))
    test = data.test.select(*keys, "date", (F.col("label") + F.col("level")).alias("label"))
    return left_by_key(test, sma, [*keys, "date"])


def baseline_score(panel: DataFrame, data: HorizonData, window: int, keys: Sequence[str] = (),
                   preset: Preset = CORRECTED, pct: float = SPLIT_PCT) -> DataFrame:
    """``baseline_dates="series_tail"`` (the original) scores the baseline on the last ``1 - pct`` of the
    weekly series (S22); the default scores it on the same target dates as the models."""
    if preset.baseline_dates == "series_tail":
        return sma_smape(panel, window, pct, keys, preset)
    if preset.baseline_dates == "model_test":
        return smape(sma_on_test(panel, data, window, keys, preset), 0, keys, preset)
    raise ValueError(f"baseline_dates must be 'series_tail' or 'model_test', not {preset.baseline_dates!r}")


def _tag(score: DataFrame, model: str, h: int, keys: Sequence[str] = ()) -> DataFrame:
    return score.select(*keys, F.lit(MODEL_NAMES[model]).alias("model"), F.lit(h).alias("horizon"),
                        F.col("smape").cast(T.DoubleType()).alias("smape"))


def compare(
    panel: DataFrame,
    horizons: Sequence[int] = (1, 2, 3),
    models: Sequence[str] = ("rf", "dt", "lr", "gbt"),
    preset: Preset = CORRECTED,
    pinned: Mapping[tuple[str, int], Mapping[str, object]] | None = None,
    grids: Mapping[str, Mapping[str, Sequence[object]]] | None = None,
    sma_windows: Mapping[int, int] | None = None,
    parallelism: int = 8,
    keys: Sequence[str] = (),
    feature_cols: Mapping[int, Sequence[str]] | None = None,
) -> tuple[DataFrame, list[ModelRun]]:
    """Long frame ``(keys..., model, horizon, smape)`` over models x horizons, plus the runs themselves.
    Without keys: the single weekly series of the original. With keys: one global model per
    horizon over every series, scored per series. ``parallelism`` bounds the fits in flight over the whole
    call: cells with given parameters share one pool, a cell that tunes gives the pool to its own fits. The
    scores come from one aggregate over the predictions of all cells."""
    keys = list(keys)
    pinned = PINNED if pinned is None else pinned
    grids = PARAM_GRIDS if grids is None else grids
    sma_windows = SMA_WINDOWS if sma_windows is None else sma_windows
    panel = materialize(panel)
    data = {h: prepare_horizon(panel, h, keys, preset, feature_cols=(feature_cols or {}).get(h)) for h in horizons}

    cells = [(m, h) for h in horizons for m in models]
    given = [c for c in cells if c in pinned]
    runs = dict(zip(given, in_parallel(
        lambda c: run_model(data[c[1]], c[0], pinned[c], None, keys, preset), given, parallelism)))
    for m, h in cells:
        if (m, h) not in runs:
            runs[m, h] = run_model(data[h], m, None, grids.get(m), keys, preset, parallelism)

    parts = [_tag(baseline_score(panel, data[h], sma_windows[h], keys, preset), "sma", h, keys)
             for h in horizons if h in sma_windows]
    forecasts = None
    for m, h in cells:
        own = runs[m, h].predictions.select(*keys, "date", "prediction", "label", F.lit(MODEL_NAMES[m]).alias("model"),
                                            F.lit(h).alias("horizon"))
        forecasts = own if forecasts is None else forecasts.unionByName(own)
    if forecasts is not None:
        score = smape(forecasts, _trim_by_horizon(preset), [*keys, "model", "horizon"], preset)
        parts.append(score.select(*keys, "model", "horizon", F.col("smape").cast(T.DoubleType()).alias("smape")))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    long = materialize(long)
    for d in data.values():
        d.release()
    release(panel)
    return long, [runs[c] for c in cells]


def _trim_by_horizon(preset: Preset):
    """Rows past the series end carry a filled, not a real, label when ``label_fill`` is set: trim them."""
    return F.col("horizon") if preset.label_fill is not None else 0


def accuracy_table(long: DataFrame, horizons: Sequence[int] = (1, 2, 3), keys: Sequence[str] = ()) -> DataFrame:
    """``(keys..., model, 1 week, 2 weeks, 3 weeks)``; a missing cell (no baseline at 1 week) is null.
    The pivot values are listed, so Spark needs no extra job to find them."""
    keys = list(keys)
    names = {h: f"{h} week" if h == 1 else f"{h} weeks" for h in horizons}
    wide = long.groupBy(*keys, "model").pivot("horizon", list(horizons)).agg(F.first("smape"))
    order = F.create_map(*[x for i, m in enumerate(MODEL_NAMES.values()) for x in (F.lit(m), F.lit(i))])
    return wide.select(*keys, "model", *[F.col(str(h)).alias(names[h]) for h in horizons]).orderBy(
        *keys, order[F.col("model")])
