from weekcast.plans.models import estimator, fit_predict
from weekcast.plans.report import accuracy_table, compare, prepare_horizon, run_model
from weekcast.plans.select import feature_importance, select_features
from weekcast.plans.tune import best_params, param_grid, rolling_cv

__all__ = ["accuracy_table", "best_params", "compare", "estimator", "feature_importance",
           "fit_predict", "param_grid", "prepare_horizon", "rolling_cv", "run_model", "select_features"]
