"""Fixed values.

Every value here must equal the original notebook's for the results to match; they are stated once and
imported wherever they are used.
"""

from __future__ import annotations

# -- Fixed values from the original notebook ----------------------------------------------------------

# text dates in the retail tables
DATE_FORMAT = "dd/MM/yyyy"
# rows per seasonal cycle ("one year" of weekly rows)
SEASON = 48
# lags per horizon: h .. h + 3; moving mean / deviation frames of k + 1 rows for the same k
N_LAGS = 4
# chronological train share
SPLIT_PCT = 0.8
# a feature is kept when its forest importance is above this
IMPORTANCE_THRESHOLD = 0.03
# rolling cross-validation: folds, and the modulus that sizes the fixed first training block
CV_FOLDS = 2
CV_FIXED_MODULUS = 10
# hyper-parameter grids, in the notebook's key order (the first key varies slowest)
PARAM_GRIDS: dict[str, dict[str, list[str]]] = {
    "lr": {"RegParam": ["0", "0.1", "0.5"], "ElasticNetParam": ["0", "0.1", "0.5"]},
    "rf": {"NumTrees": ["5", "10", "15"], "MaxBins": ["28", "30", "32"]},
    "dt": {"MaxDepth": ["5", "7", "10"], "MaxBins": ["20", "25", "30"]},
    "gbt": {"MaxIter": ["5", "7", "10"], "MaxBins": ["23", "25", "27"], "MaxDepth": ["6", "8", "10"]},
}
# covariate columns of the retail tables
RETAIL_COVARIATES = ("Temperature", "Fuel_Price", "MarkDown1", "MarkDown2", "MarkDown3", "MarkDown4",
                     "MarkDown5", "CPI", "Unemployment")
# text that stands for a missing number
MISSING = "NA"
# model labels of the accuracy table, by model code
MODEL_NAMES = {
    "sma": "SMA",
    "rf": "Random Forest",
    "dt": "Decision Tree",
    "lr": "Linear Regression",
    "gbt": "Gradient Boosted Tree",
}
# moving-average baseline window per horizon (no baseline at 1 week)
SMA_WINDOWS = {2: 2, 3: 3}
# parameters pinned after tuning, by (model, horizon in weeks); other cells use the CV winner
PINNED: dict[tuple[str, int], dict[str, str]] = {
    ("lr", 1): {"RegParam": "0.5", "ElasticNetParam": "0"},
    ("dt", 1): {"MaxDepth": "5", "MaxBins": "20"},
    ("gbt", 1): {"MaxIter": "5", "MaxDepth": "6", "MaxBins": "23"},
    ("rf", 2): {"NumTrees": "15", "MaxBins": "28"},
    ("lr", 2): {"RegParam": "0.5", "ElasticNetParam": "0"},
    ("dt", 2): {"MaxDepth": "5", "MaxBins": "20"},
    ("gbt", 2): {"MaxIter": "5", "MaxDepth": "6", "MaxBins": "23"},
    ("rf", 3): {"NumTrees": "15", "MaxBins": "28"},
    ("lr", 3): {"RegParam": "0.1", "ElasticNetParam": "0"},
    ("dt", 3): {"MaxDepth": "5", "MaxBins": "20"},
}
