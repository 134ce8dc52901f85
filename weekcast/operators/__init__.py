from weekcast.operators.evaluate import retrend, retrend_by_join, rmse, sma_forecast, sma_smape, smape
from weekcast.operators.features import build_features, horizon_label, lag_features, rolling_stats, seasonal_diff
from weekcast.operators.panel import calendar_features, fill_weeks, merge_tables, undated_sales, weekly_panel
from weekcast.operators.split import rolling_folds, split_frame, ts_split

__all__ = ["build_features", "calendar_features", "fill_weeks", "horizon_label", "lag_features", "merge_tables",
           "retrend", "retrend_by_join", "rmse", "rolling_folds", "rolling_stats", "seasonal_diff",
           "sma_forecast", "sma_smape", "smape", "split_frame", "ts_split", "undated_sales",
           "weekly_panel"]
