"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame`` over
the driver's tables (mapping in ``weekcast.sources.fixtures``). Their SQL twins are in
``weekcast.oracle``; column names and rounding match one to one.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.config import CORRECTED, REFERENCE, Preset
from weekcast.constants import CV_FOLDS, DATE_FORMAT, MISSING, PARAM_GRIDS, PINNED, SPLIT_PCT
from weekcast.functions.columns import holiday_flag, parse_date
from weekcast.hygiene import tidy
from weekcast.operators.between import features_between
from weekcast.operators.evaluate import retrend, retrend_by_join, rmse, sma_test_frame, smape
from weekcast.operators.features import (
    build_features,
    feature_names,
    horizon_label,
    lag_features,
    lag_name,
    ma_name,
    rolling_stats,
    seasonal_diff,
    std_name,
)
from weekcast.operators.panel import fill_weeks, merge_tables, weekly_panel
from weekcast.operators.period_lags import features_by_period
from weekcast.operators.ranges import build_features_by_ranges, sma_by_ranges, split_by_ranges
from weekcast.operators.split import TEST, TRAIN, fold_summary, purge_gap, rolling_folds, split_frame
from weekcast.plans.models import fit_predict, linear_fit_coefficients
from weekcast.plans.report import accuracy_table, compare, prepare_horizon, run_model
from weekcast.plans.select import candidate_columns, feature_importance, ranked, selected
from weekcast.plans.tune import cv_summary, rolling_cv
from weekcast.session import materialize, release
from weekcast.sources.fixtures import COVARIATES, HOLIDAY_FLAGS, LINEITEM_SCHEMA, fixture_tables, week_start
from weekcast.sources.tables import MONEY, catalog_tables, preview, retail_features, retail_sales, shape

Query = Callable[[SparkSession, str], DataFrame]

KEYED = ("nation",)
HORIZONS = (1, 2, 3)


# -- shared building blocks ---------------------------------------------------------------------------

def tables(spark: SparkSession, sf_dir: str, roles=("sales", "features", "stores")) -> dict[str, DataFrame]:
    return fixture_tables(spark, sf_dir, roles)


def panel(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = (), weeks: tuple[dt.date, dt.date] | None = None) -> DataFrame:
    needs_dim = any(k not in ("store", "dept", "date", "flag") for k in keys)
    t = fixture_tables(spark, sf_dir, ("sales", "features", "stores") if needs_dim else ("sales", "features"), weeks)
    return weekly_panel(
        t["sales"], t["features"], t.get("stores"), keys=keys, covariates=COVARIATES,
        holiday_values=HOLIDAY_FLAGS, normalize_flag=False,
    )


def features(spark: SparkSession, sf_dir: str, h: int, preset: Preset, keys: tuple[str, ...] = ()) -> DataFrame:
    return build_features(panel(spark, sf_dir, keys), h, keys, preset)


def feature_columns(h: int, keys: tuple[str, ...] = ()) -> list[str]:
    return [*keys, "date", *COVARIATES, "is_holiday", "month", "day", "label", "diff_sales", *feature_names(h)]


def naive_predictions(spark: SparkSession, sf_dir: str, h: int, preset: Preset) -> DataFrame:
    """Test rows with the naive forecast "the difference stays as it is now" (prediction = diff_sales)."""
    s = split_frame(features(spark, sf_dir, h, preset), SPLIT_PCT, purge_gap(h), (), preset)
    return s.where(F.col("role") == TEST).select("date", F.col("diff_sales").alias("prediction"), "label", "level")


# -- scans, merge, flags, dates -------------------------------------------------------------------------

def q_table_shapes(spark, sf_dir):
    t = tables(spark, sf_dir)
    return shape(t["sales"], "sales").unionByName(shape(t["features"], "features")).unionByName(
        shape(t["stores"], "stores")).withColumnRenamed("table", "table_name")


def q_table_preview(spark, sf_dir):
    return tidy(preview(tables(spark, sf_dir, ("sales",))["sales"], ["store", "dept", "flag", "date", "weekly_sales"], 10))


def q_table_preview_features(spark, sf_dir):
    return tidy(preview(tables(spark, sf_dir, ("features",))["features"], ["store", "date", "flag"], 10))


def q_table_preview_stores(spark, sf_dir):
    return tidy(preview(tables(spark, sf_dir, ("stores",))["stores"], ["store"], 10))


def q_merge_left_three_keys(spark, sf_dir):
    t = tables(spark, sf_dir, ("sales", "features"))
    return tidy(merge_tables(t["sales"], t["features"]))


def q_merge_left_dimension(spark, sf_dir):
    t = tables(spark, sf_dir)
    return tidy(merge_tables(t["sales"], t["features"], t["stores"]))


def q_merge_left_dimension_spread(spark, sf_dir):
    """The same rows with heavy keys split by a salt: here every store with more than 100 rows."""
    t = tables(spark, sf_dir)
    return tidy(merge_tables(t["sales"], t["features"], t["stores"], rows_per_task=100))


def q_flag_encode(spark, sf_dir):
    s = tables(spark, sf_dir, ("sales",))["sales"]
    return s.select("store", "dept", "date", "flag", holiday_flag("flag", HOLIDAY_FLAGS, False).alias("is_holiday"))


def q_date_parse(spark, sf_dir):
    s = tables(spark, sf_dir, ("sales",))["sales"].select(
        "store", "dept", "flag", F.date_format("date", DATE_FORMAT).alias("date_text"))
    return s.withColumn("date", parse_date("date_text", DATE_FORMAT))


# -- roll-up and features ------------------------------------------------------------------------------

def q_weekly_panel(spark, sf_dir):
    return tidy(panel(spark, sf_dir))


def q_weekly_panel_keyed(spark, sf_dir):
    return tidy(panel(spark, sf_dir, KEYED))


def q_weekly_panel_by_store(spark, sf_dir):
    return tidy(panel(spark, sf_dir, ("store",)))


def q_weekly_panel_by_store_filled(spark, sf_dir):
    keys = ("store",)
    return tidy(fill_weeks(panel(spark, sf_dir, keys), keys))


def q_features_by_store_filled(spark, sf_dir):
    """Per-supplier features over calendar weeks: missing weeks are rows, so a lag of 48 is 48 weeks."""
    keys = ("store",)
    filled = fill_weeks(panel(spark, sf_dir, keys), keys)
    return tidy(build_features(filled, 1, keys, CORRECTED).select(*feature_columns(1, keys), "level"))


def _scaled_panel(spark, sf_dir, price: float = 1.0, covariate: tuple[float, float] = (1.0, 1.0)):
    t = tables(spark, sf_dir, ("sales", "features"))
    sales = t["sales"].withColumn("weekly_sales", (F.col("weekly_sales") / F.lit(int(price))).cast(MONEY)) if price != 1.0 else t["sales"]
    feats = t["features"].withColumns({c: F.col(c) * F.lit(x) for c, x in zip(COVARIATES, covariate)})
    return weekly_panel(sales, feats, covariates=COVARIATES, holiday_values=HOLIDAY_FLAGS, normalize_flag=False)


def q_weekly_panel_wide_range(spark, sf_dir):
    """Covariates far beyond and far below one: scaled by 1e21 and 1e-19, then scaled back for the comparison."""
    p = _scaled_panel(spark, sf_dir, covariate=(1e21, 1e-19))
    return tidy(p.withColumns({"temp": F.col("temp") / F.lit(1e21), "cpi": F.col("cpi") / F.lit(1e-19)}))


def q_weekly_panel_subcent(spark, sf_dir):
    """Prices a thousandth of their size: sub-cent digits count towards the weekly total."""
    return tidy(_scaled_panel(spark, sf_dir, price=1000.0))


def retail_layout(spark, sf_dir) -> None:
    """Temporary views ``sales`` and ``features`` in the original's layout over lineitem: text dates, text
    flags in mixed spelling, ``NA`` for missing numbers."""
    base = f"{sf_dir.rstrip('/')}/lineitem.parquet"
    line = spark.read.schema(LINEITEM_SCHEMA).parquet(base).select(
        F.col("l_suppkey").alias("Store"), F.col("l_partkey").alias("Dept"),
        F.date_format(week_start("l_shipdate"), DATE_FORMAT).alias("Date"),
        F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax"), (F.col("l_returnflag") == "R").alias("holiday"))
    line.select("Store", "Dept", "Date", F.col("l_extendedprice").cast("string").alias("Weekly_Sales"),
                F.when(F.col("holiday"), "TRUE").otherwise("False").alias("IsHoliday")).createOrReplaceTempView("sales")
    number = lambda c: F.when(F.col("Store") % 10 == 0, MISSING).otherwise(F.avg(c).cast("string"))
    feats = line.groupBy("Store", "Date", "holiday").agg(number("l_discount").alias("Temperature"), number("l_tax").alias("CPI"))
    feats.select("Store", "Date", "Temperature", "CPI",
                 F.when(F.col("holiday"), " True ").otherwise("FALSE").alias("IsHoliday")).createOrReplaceTempView("features")


def _retail_panel(spark, sf_dir):
    retail_layout(spark, sf_dir)
    t = catalog_tables(spark, ("sales", "features"))
    return weekly_panel(retail_sales(t["sales"]), retail_features(t["features"], covariates=("Temperature", "CPI")),
                        covariates={"temp": "temperature", "cpi": "cpi"})


def q_weekly_panel_retail_layout(spark, sf_dir):
    return tidy(_retail_panel(spark, sf_dir))


def q_features_retail_layout(spark, sf_dir):
    return tidy(build_features(_retail_panel(spark, sf_dir), 1, (), REFERENCE).select(*feature_columns(1)))


def q_features_by_store(spark, sf_dir):
    keys = ("store",)
    return tidy(features(spark, sf_dir, 1, CORRECTED, keys).select(*feature_columns(1, keys), "level"))


def q_calendar_features(spark, sf_dir):
    return panel(spark, sf_dir).select("date", "month", "day")


def q_seasonal_diff(spark, sf_dir):
    return tidy(seasonal_diff(panel(spark, sf_dir), (), REFERENCE).select("date", "total_sales", "lag_1year", "diff_sales"))


def q_seasonal_diff_signed(spark, sf_dir):
    return tidy(seasonal_diff(panel(spark, sf_dir), (), CORRECTED).select("date", "total_sales", "lag_1year", "diff_sales"))


def q_lag_features(spark, sf_dir):
    d = lag_features(seasonal_diff(panel(spark, sf_dir), (), REFERENCE), 1, (), REFERENCE)
    return tidy(d.select("date", "diff_sales", *[lag_name(k) for k in range(1, 5)]))


def q_lead_label(spark, sf_dir):
    """The 3-week label (lead with the 0 default) on the seasonally differenced series."""
    d = horizon_label(seasonal_diff(panel(spark, sf_dir), (), REFERENCE), 3, (), REFERENCE)
    return tidy(d.select("date", "diff_sales", "label"))


def _stats(spark, sf_dir):
    d = lag_features(seasonal_diff(panel(spark, sf_dir), (), REFERENCE), 1, (), REFERENCE)
    return rolling_stats(d, 1, (), REFERENCE)


def q_rolling_mean(spark, sf_dir):
    return tidy(_stats(spark, sf_dir).select("date", "lag_1week", *[ma_name(k) for k in range(1, 5)]))


def q_rolling_std(spark, sf_dir):
    return tidy(_stats(spark, sf_dir).select("date", "lag_1week", *[std_name(k) for k in range(1, 5)]))


def _features_query(h: int, preset: Preset, keys: tuple[str, ...] = (), level: bool = False) -> Query:
    def q(spark, sf_dir):
        cols = feature_columns(h, keys) + (["level"] if level else [])
        return tidy(features(spark, sf_dir, h, preset, keys).select(*cols))
    return q


def q_features_h1_by_ranges(spark, sf_dir):
    """The corrected 1-week features of the one series, windows by ranges of 128 rows."""
    f = build_features_by_ranges(panel(spark, sf_dir), 1, CORRECTED, rows=128)
    return tidy(f.select(*feature_columns(1), "level"))


def q_sma_by_ranges(spark, sf_dir):
    return tidy(sma_by_ranges(panel(spark, sf_dir), 3, rows=100).select("date", "total_sales", "sma"))


#: dates of the range queries, both included
BETWEEN = (dt.date(1998, 6, 1), dt.date(1999, 5, 31))


def _between_query(keys: tuple[str, ...] = ()) -> Query:
    """Features of one year of target weeks, from the weeks that they need."""
    def q(spark, sf_dir):
        calendar = tables(spark, sf_dir, ("sales",))["sales"].select(*keys, "date").distinct()
        f = features_between(calendar, lambda lo, hi: panel(spark, sf_dir, keys, (lo, hi)), BETWEEN, 1, keys, CORRECTED)
        return tidy(f.select(*feature_columns(1, keys), "level"))
    return q


def q_features_by_period(spark, sf_dir):
    """Per-supplier lags by calendar without filling weeks: a missing week gives a null."""
    f = features_by_period(panel(spark, sf_dir, ("store",)), 1, ("store",), CORRECTED)
    return tidy(f.select("store", "date", "total_sales", "lag_1year", "diff_sales", *[lag_name(k) for k in range(1, 5)], "label"))


# -- split, gap, folds ---------------------------------------------------------------------------------

def _split_query(h: int, role: str, gap: bool) -> Query:
    """Rows of one role of the 80/20 split of the h-week frame, with or without the purge gap."""
    def q(spark, sf_dir):
        s = split_frame(features(spark, sf_dir, h, REFERENCE), SPLIT_PCT, purge_gap(h) if gap else 0, (), REFERENCE)
        return tidy(s.where(F.col("role") == role).select("date", "row_ix", "n_rows", "cut", "label", "diff_sales"))
    return q


def q_ts_split_raw(spark, sf_dir):
    """80/20 split of the raw sales rows in time order, without a window over all of them."""
    order = ("date", "store", "dept", "flag", "weekly_sales")
    s = split_by_ranges(tables(spark, sf_dir, ("sales",))["sales"], SPLIT_PCT, 0, order, CORRECTED)
    return tidy(s.select(*order, "row_ix", "n_rows", "cut", "role"))


def _folds_query(preset: Preset) -> Query:
    """Fold summary of the rolling CV over the purged 1-week training rows."""
    def q(spark, sf_dir):
        h = 1
        s = split_frame(features(spark, sf_dir, h, preset), SPLIT_PCT, purge_gap(h), (), preset)
        train = s.where(F.col("role") == TRAIN).drop("row_ix", "n_rows", "cut", "role")
        return fold_summary(rolling_folds(train, 2, purge_gap(h), (), preset))
    return q


def q_ts_split_keyed(spark, sf_dir):
    s = split_frame(features(spark, sf_dir, 1, REFERENCE, KEYED), SPLIT_PCT, purge_gap(1), KEYED, REFERENCE)
    return tidy(s.select("nation", "date", "row_ix", "n_rows", "cut", "role", "label", "diff_sales"))


def q_rolling_folds_keyed(spark, sf_dir):
    s = split_frame(features(spark, sf_dir, 1, CORRECTED, KEYED), SPLIT_PCT, purge_gap(1), KEYED, CORRECTED)
    train = s.where(F.col("role") == TRAIN).drop("row_ix", "n_rows", "cut", "role")
    return fold_summary(rolling_folds(train, 2, purge_gap(1), KEYED, CORRECTED), KEYED)


# -- retrend and scores --------------------------------------------------------------------------------

def q_retrend_naive(spark, sf_dir):
    """Naive forecast (difference unchanged) with the origin level added back."""
    return tidy(retrend(naive_predictions(spark, sf_dir, 1, REFERENCE)).select("date", "prediction", "label"))


def q_retrend_corrected(spark, sf_dir):
    """Naive forecast with the level of the target row added back."""
    return tidy(retrend(naive_predictions(spark, sf_dir, 1, CORRECTED)).select("date", "prediction", "label"))


def q_retrend_by_key_join(spark, sf_dir):
    """Levels kept in their own frame (the original's seasonal frame), joined back on date."""
    pred = naive_predictions(spark, sf_dir, 2, REFERENCE)
    levels = features(spark, sf_dir, 2, REFERENCE).select("date", "level")
    return tidy(retrend_by_join(pred.drop("level"), levels).select("date", "prediction", "label", "level"))


def q_smape_naive(spark, sf_dir):
    """sMAPE of the retrended naive forecast, last row trimmed, all rows in the denominator."""
    return tidy(smape(retrend(naive_predictions(spark, sf_dir, 1, REFERENCE)), 1, (), REFERENCE))


def q_smape_corrected(spark, sf_dir):
    """sMAPE of the retrended naive forecast over the rows scored."""
    return tidy(smape(retrend(naive_predictions(spark, sf_dir, 1, CORRECTED)), 0, (), CORRECTED))


def q_smape_keyed(spark, sf_dir):
    """Per-series score of the naive forecast: one row per nation."""
    s = split_frame(features(spark, sf_dir, 1, CORRECTED, KEYED), SPLIT_PCT, purge_gap(1), KEYED, CORRECTED)
    pred = s.where(F.col("role") == TEST).select("nation", "date", F.col("diff_sales").alias("prediction"), "label", "level")
    return tidy(smape(retrend(pred), 0, KEYED, CORRECTED))


def q_rmse_naive(spark, sf_dir):
    """RMSE of the naive forecast of the difference."""
    return tidy(rmse(naive_predictions(spark, sf_dir, 1, REFERENCE)))


def _sma_query(window: int) -> Query:
    def q(spark, sf_dir):
        return tidy(sma_test_frame(panel(spark, sf_dir), window, SPLIT_PCT, (), CORRECTED))
    return q


def _sma_smape(preset: Preset) -> Query:
    def q(spark, sf_dir):
        p = panel(spark, sf_dir)
        parts = [
            smape(sma_test_frame(p, w, SPLIT_PCT, (), preset), 0, (), preset).select(F.lit(w).alias("sma_window"), "smape", "n_scored")
            for w in (2, 3)
        ]
        return tidy(parts[0].unionByName(parts[1]))
    return q


def q_sma_smape_keyed(spark, sf_dir):
    """Per-nation baseline scores: each nation's series split and averaged on its own."""
    p = panel(spark, sf_dir, KEYED)
    parts = [
        smape(sma_test_frame(p, w, SPLIT_PCT, KEYED, CORRECTED), 0, KEYED, CORRECTED).select(
            "nation", F.lit(w).alias("sma_window"), "smape", "n_scored")
        for w in (2, 3)
    ]
    return tidy(parts[0].unionByName(parts[1]))


def q_lr_single_feature(spark, sf_dir):
    """Unpenalised one-feature linear fit (MLlib), checked against the closed form in SQL."""
    s = split_frame(features(spark, sf_dir, 1, CORRECTED), SPLIT_PCT, purge_gap(1), (), CORRECTED)
    train = s.where(F.col("role") == TRAIN)
    return tidy(linear_fit_coefficients(train, ["diff_sales"], "label"))


# -- models (no SQL twin: tree fits are not SQL; checked by row counts and by tests) -----------------

def settled(df: DataFrame, *built_on: DataFrame) -> DataFrame:
    """``df`` evaluated (it is small), so that the materialized frames it was built on can be given up."""
    out = materialize(df)
    out.count()
    for frame in built_on:
        release(frame)
    return out


def _horizon(spark, sf_dir, h: int, preset: Preset):
    return prepare_horizon(panel(spark, sf_dir), h, (), preset)


def _predict_query(name: str) -> Query:
    """Forecasts of the 1-week test rows, with the pinned parameters or, for the forest, the CV winner."""
    def q(spark, sf_dir):
        data = _horizon(spark, sf_dir, 1, REFERENCE)
        return settled(tidy(run_model(data, name, PINNED.get((name, 1)), preset=REFERENCE).predictions), data.frame)
    return q


def q_feature_importance(spark, sf_dir):
    data = _horizon(spark, sf_dir, 1, REFERENCE)
    data.release()  # importances are driver values
    return tidy(ranked(data.importance))


def q_feature_selection(spark, sf_dir):
    data = _horizon(spark, sf_dir, 1, REFERENCE)
    data.release()
    return tidy(selected(data.importance))


def _cv(spark, sf_dir, name: str = "dt", preset: Preset = REFERENCE):
    data = _horizon(spark, sf_dir, 1, preset)
    try:
        return rolling_cv(data.train, data.features, name, PARAM_GRIDS[name], CV_FOLDS, purge_gap(1), (), preset)
    finally:
        data.release()


def _cv_query(name: str, preset: Preset = REFERENCE) -> Query:
    """Every (parameter set, fold) score of the model's whole grid. The reference's folds train on ``n % 10`` rows,
    fewer than there are inputs; the corrected ones on a third and two thirds of the rows."""
    def q(spark, sf_dir):
        return tidy(_cv(spark, sf_dir, name, preset))
    return q


def q_best_params(spark, sf_dir):
    return tidy(cv_summary(_cv(spark, sf_dir)).limit(1))


def q_model_run_pinned(spark, sf_dir):
    """Score of every pinned cell: model, horizon and its parameters."""
    p = materialize(panel(spark, sf_dir))
    data = {h: prepare_horizon(p, h, (), REFERENCE) for h in HORIZONS}
    parts = [run_model(data[h], m, params, preset=REFERENCE).score.select(
        F.lit(m).alias("model"), F.lit(h).alias("horizon"), F.lit(json.dumps(params, sort_keys=True)).alias("params"), "smape", "n_scored")
        for (m, h), params in PINNED.items()]
    return settled(tidy(reduce(DataFrame.unionByName, parts)), p, *[d.frame for d in data.values()])


def q_predict_keyed(spark, sf_dir):
    """One global model over every nation's series, which enter through their own level and scale."""
    data = prepare_horizon(panel(spark, sf_dir, KEYED), 1, KEYED, CORRECTED)
    return settled(tidy(run_model(data, "gbt", PINNED[("gbt", 1)], keys=KEYED, preset=CORRECTED).predictions), data.frame)


def _comparison(preset: Preset) -> Query:
    """The accuracy table: models x horizons, CV winners where the original tunes."""
    def q(spark, sf_dir):
        long, _ = compare(panel(spark, sf_dir), preset=preset)
        return tidy(accuracy_table(long))
    return q


def q_accuracy_comparison_keyed(spark, sf_dir):
    """Per-nation accuracy table: one global model per horizon over every nation's series, tuned where the
    single-series table is."""
    long, _ = compare(panel(spark, sf_dir, KEYED), preset=CORRECTED, keys=KEYED)
    return tidy(accuracy_table(long, keys=KEYED))


def q_accuracy_comparison_tuned(spark, sf_dir):
    """All twelve (model, horizon) cells tuned over their whole grids, none pinned."""
    long, _ = compare(panel(spark, sf_dir), preset=REFERENCE, pinned={})
    return tidy(accuracy_table(long))


# -- models with a closed form (SQL twins) ---------------------------------------------------------------
#
# One split on `month`, one feature under a ridge penalty: fits that SQL can state. They go through the same
# estimator(), fit_predict(), rolling_cv(), run_model() and compare() as the full-size queries.

STUMP = {
    "dt": {"MaxDepth": "1", "MaxBins": "32"},
    "gbt": {"MaxIter": "1", "MaxDepth": "1", "MaxBins": "32"},
    "rf": {"NumTrees": "1", "MaxDepth": 1, "Bootstrap": False, "MaxBins": "32"},
}
STUMP_FEATURES = ("month", "day")
RIDGE_FEATURE = "lag_1week"
RIDGE_PARAMS = {"RegParam": "0.5", "ElasticNetParam": "0"}
RIDGE_GRID = {"RegParam": PARAM_GRIDS["lr"]["RegParam"], "ElasticNetParam": ["0"]}


def _simple_horizon(spark, sf_dir, columns, preset=CORRECTED, h: int = 1):
    return prepare_horizon(panel(spark, sf_dir), h, (), preset, feature_cols=list(columns))


def _stump_query(name: str) -> Query:
    """Depth-1 fit on the month: two means, left and right of the best split."""
    def q(spark, sf_dir):
        data = _simple_horizon(spark, sf_dir, ["month"])
        return settled(tidy(fit_predict(data.train, data.test, ["month"], name, STUMP[name], CORRECTED, keep=("date", "month"))), data.frame)
    return q


#: inputs with more values than a tree has bins
WIDE_FEATURES = ("diff_sales", "lag_1week", "std_4weeks", "month")


def _forest(depth: int, bins: int) -> dict:
    """Two trees without bootstrap on all columns: twice the same tree."""
    return {"NumTrees": "2", "MaxDepth": depth, "Bootstrap": False, "FeatureSubsetStrategy": "all", "MaxBins": str(bins)}


def _tree(depth: int, bins: int) -> dict:
    return {"MaxDepth": str(depth), "MaxBins": str(bins)}


def _boosted(iterations: int, depth: int, bins: int) -> dict:
    return {"MaxIter": str(iterations), "MaxDepth": str(depth), "MaxBins": str(bins)}


def _tree_query(name: str, params: dict, columns: tuple[str, ...] = STUMP_FEATURES) -> Query:
    """Deeper trees, more of them, and boosting: splits that SQL can search level by level."""
    def q(spark, sf_dir):
        data = _simple_horizon(spark, sf_dir, columns)
        return settled(tidy(fit_predict(data.train, data.test, columns, name, params, CORRECTED, keep=("date", "month", "day"))), data.frame)
    return q


def _tree_importance(params: dict, columns: tuple[str, ...]) -> Query:
    """Importance as summed gains over the candidate columns of a frame with these inputs."""
    def q(spark, sf_dir):
        data = _simple_horizon(spark, sf_dir, columns)
        inputs = candidate_columns(data.frame.select("date", "label", "level", "role", *columns))
        scores = feature_importance(data.train, inputs, CORRECTED, params)
        data.release()
        return tidy(ranked(scores))
    return q


def _nested_cv(name: str, grid: dict, columns: tuple[str, ...] = STUMP_FEATURES) -> Query:
    """CV of a grid whose sets share one fit for each fold."""
    def q(spark, sf_dir):
        data = _simple_horizon(spark, sf_dir, columns)
        cv = rolling_cv(data.train, data.features, name, grid, CV_FOLDS, purge_gap(1), (), CORRECTED)
        data.release()
        return tidy(cv.select("model", "param_ix", "fold", "n_train", "n_test", "metric", "score"))
    return q


def q_predict_lr_single(spark, sf_dir):
    """Ridge on one feature through the original's own estimator settings."""
    data = _simple_horizon(spark, sf_dir, [RIDGE_FEATURE])
    return settled(tidy(fit_predict(data.train, data.test, [RIDGE_FEATURE], "lr", RIDGE_PARAMS, CORRECTED, keep=("date",))), data.frame)


def _stump_importance(spark, sf_dir):
    data = _simple_horizon(spark, sf_dir, STUMP_FEATURES)
    scores = feature_importance(data.train, STUMP_FEATURES, CORRECTED, {**STUMP["rf"], "FeatureSubsetStrategy": "all"})
    data.release()
    return scores


def q_feature_importance_stump(spark, sf_dir):
    return tidy(ranked(_stump_importance(spark, sf_dir)))


def q_feature_selection_stump(spark, sf_dir):
    return tidy(selected(_stump_importance(spark, sf_dir)))


def _ridge_cv(spark, sf_dir):
    data = _simple_horizon(spark, sf_dir, [RIDGE_FEATURE])
    scores = rolling_cv(data.train, data.features, "lr", RIDGE_GRID, CV_FOLDS, purge_gap(1), (), CORRECTED)
    data.release()
    return scores


def q_cv_results_ridge(spark, sf_dir):
    return tidy(_ridge_cv(spark, sf_dir).select("model", "param_ix", "fold", "n_train", "n_test", "metric", "score"))


def q_best_params_ridge(spark, sf_dir):
    return tidy(cv_summary(_ridge_cv(spark, sf_dir)).limit(1).select("model", "param_ix", "mean_score", "folds"))


def q_model_run_ridge(spark, sf_dir):
    """Ridge forecasts of the test rows with the level added back."""
    data = _simple_horizon(spark, sf_dir, [RIDGE_FEATURE])
    return settled(tidy(run_model(data, "lr", RIDGE_PARAMS, preset=CORRECTED).predictions.select("date", "prediction", "label")), data.frame)


def _ridge_table(preset: Preset, keys: tuple[str, ...] = ()) -> Query:
    """Accuracy table of the ridge and the moving average, three horizons."""
    def q(spark, sf_dir):
        pinned = {("lr", h): RIDGE_PARAMS for h in HORIZONS}
        features_of = {h: [lag_name(h)] for h in HORIZONS}
        long, _ = compare(panel(spark, sf_dir, keys), models=("lr",), preset=preset, pinned=pinned, keys=keys, feature_cols=features_of)
        return tidy(accuracy_table(long, keys=keys))
    return q


REGISTRY: dict[str, Query] = {
    "table_shapes": q_table_shapes,
    "table_preview": q_table_preview,
    "table_preview_features": q_table_preview_features,
    "table_preview_stores": q_table_preview_stores,
    "merge_left_three_keys": q_merge_left_three_keys,
    "merge_left_dimension": q_merge_left_dimension,
    "flag_encode": q_flag_encode,
    "date_parse": q_date_parse,
    "weekly_panel": q_weekly_panel,
    "weekly_panel_keyed": q_weekly_panel_keyed,
    "weekly_panel_by_store": q_weekly_panel_by_store,
    "weekly_panel_by_store_filled": q_weekly_panel_by_store_filled,
    "features_by_store_filled": q_features_by_store_filled,
    "weekly_panel_wide_range": q_weekly_panel_wide_range,
    "weekly_panel_subcent": q_weekly_panel_subcent,
    "weekly_panel_retail_layout": q_weekly_panel_retail_layout,
    "features_retail_layout": q_features_retail_layout,
    "calendar_features": q_calendar_features,
    "seasonal_diff": q_seasonal_diff,
    "seasonal_diff_signed": q_seasonal_diff_signed,
    "lag_features": q_lag_features,
    "lead_label": q_lead_label,
    "rolling_mean": q_rolling_mean,
    "rolling_std": q_rolling_std,
    "features_h1": _features_query(1, REFERENCE),
    "features_h2": _features_query(2, REFERENCE),
    "features_h3": _features_query(3, REFERENCE),
    "features_keyed": _features_query(1, REFERENCE, KEYED),
    "features_h1_corrected": _features_query(1, CORRECTED, level=True),
    "features_by_store": q_features_by_store,
    "ts_split_train": _split_query(1, TRAIN, False),
    "ts_split_test": _split_query(1, TEST, False),
    "purged_train_h1": _split_query(1, TRAIN, True),
    "purged_train_h2": _split_query(2, TRAIN, True),
    "purged_train_h3": _split_query(3, TRAIN, True),
    "ts_split_keyed": q_ts_split_keyed,
    "rolling_folds": _folds_query(CORRECTED),
    "rolling_folds_keyed": q_rolling_folds_keyed,
    "rolling_folds_fixed": _folds_query(REFERENCE),
    "retrend_naive": q_retrend_naive,
    "retrend_corrected": q_retrend_corrected,
    "retrend_by_key_join": q_retrend_by_key_join,
    "smape_naive": q_smape_naive,
    "smape_corrected": q_smape_corrected,
    "smape_keyed": q_smape_keyed,
    "rmse_naive": q_rmse_naive,
    "sma_2": _sma_query(2),
    "sma_3": _sma_query(3),
    "sma_smape": _sma_smape(CORRECTED),
    "sma_smape_day_order": _sma_smape(REFERENCE),
    "sma_smape_keyed": q_sma_smape_keyed,
    "lr_single_feature": q_lr_single_feature,
    "predict_rf": _predict_query("rf"),
    "predict_dt": _predict_query("dt"),
    "predict_gbt": _predict_query("gbt"),
    "predict_lr": _predict_query("lr"),
    "feature_importance": q_feature_importance,
    "feature_selection": q_feature_selection,
    "cv_results": _cv_query("dt"),
    "cv_results_lr": _cv_query("lr"),
    "cv_results_rf": _cv_query("rf"),
    "cv_results_dt": _cv_query("dt"),
    "cv_results_gbt": _cv_query("gbt"),
    "best_params": q_best_params,
    "model_run_pinned": q_model_run_pinned,
    "predict_keyed": q_predict_keyed,
    "accuracy_comparison": _comparison(REFERENCE),
    "accuracy_comparison_corrected": _comparison(CORRECTED),
    "accuracy_comparison_keyed": q_accuracy_comparison_keyed,
    "accuracy_comparison_tuned": q_accuracy_comparison_tuned,
    "predict_lr_single": q_predict_lr_single,
    "predict_dt_stump": _stump_query("dt"),
    "predict_gbt_stump": _stump_query("gbt"),
    "predict_rf_stump": _stump_query("rf"),
    "feature_importance_stump": q_feature_importance_stump,
    "feature_selection_stump": q_feature_selection_stump,
    "predict_dt_depth2": _tree_query("dt", _tree(2, 32)),
    "predict_rf_two": _tree_query("rf", _forest(2, 32)),
    "predict_gbt_two": _tree_query("gbt", _boosted(2, 1, 32)),
    "predict_gbt_two_depth2": _tree_query("gbt", _boosted(2, 2, 32)),
    "feature_importance_depth2": _tree_importance(_forest(2, 32), STUMP_FEATURES),
    "predict_dt_depth3_binned": _tree_query("dt", _tree(3, 20), WIDE_FEATURES),
    "predict_rf_depth3_binned": _tree_query("rf", _forest(3, 28), WIDE_FEATURES),
    "predict_gbt_three_binned": _tree_query("gbt", _boosted(3, 2, 23), WIDE_FEATURES),
    "feature_importance_depth3": _tree_importance(_forest(3, 28), WIDE_FEATURES),
    "cv_results_dt_nested": _nested_cv("dt", {"MaxDepth": ["1", "2"], "MaxBins": ["32"]}),
    "cv_results_dt_binned": _nested_cv("dt", {"MaxDepth": ["1", "2"], "MaxBins": ["20", "25"]}, WIDE_FEATURES),
    "cv_results_gbt_nested": _nested_cv("gbt", {"MaxIter": ["1", "2"], "MaxDepth": ["1"], "MaxBins": ["32"]}),
    "cv_results_gbt_binned": _nested_cv("gbt", {"MaxIter": ["1", "2", "3"], "MaxDepth": ["1"], "MaxBins": ["23"]}, WIDE_FEATURES),
    "cv_results_lr_corrected": _cv_query("lr", CORRECTED),
    "cv_results_rf_corrected": _cv_query("rf", CORRECTED),
    "cv_results_dt_corrected": _cv_query("dt", CORRECTED),
    "cv_results_gbt_corrected": _cv_query("gbt", CORRECTED),
    "features_h1_by_ranges": q_features_h1_by_ranges,
    "sma_by_ranges": q_sma_by_ranges,
    "ts_split_raw": q_ts_split_raw,
    "features_between": _between_query(),
    "features_between_by_store": _between_query(("store",)),
    "features_by_period": q_features_by_period,
    "merge_left_dimension_spread": q_merge_left_dimension_spread,
    "cv_results_ridge": q_cv_results_ridge,
    "best_params_ridge": q_best_params_ridge,
    "model_run_ridge": q_model_run_ridge,
    "accuracy_comparison_ridge": _ridge_table(CORRECTED),
    "accuracy_comparison_ridge_reference": _ridge_table(REFERENCE),
    "accuracy_comparison_ridge_keyed": _ridge_table(CORRECTED, KEYED),
}
