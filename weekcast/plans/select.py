"""Feature importance and selection (inventory I10, F3, B10).

A default random forest is fitted on the training rows; its importances come back as a small frame
(one row per input column) and the columns scoring above a threshold are kept, in input order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.config import CORRECTED, Preset
from weekcast.constants import IMPORTANCE_THRESHOLD
from weekcast.plans.models import assemble, estimator

#: columns that are never model inputs: time, target, seasonal level and split / fold bookkeeping
NOT_FEATURES = frozenset({"date", "label", "level", "lag_1year", "total_sales", "row_ix", "n_rows", "cut", "role",
                          "fold", "features", "prediction"})

_NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.DecimalType)


def candidate_columns(df: DataFrame, keys: Sequence[str] = ()) -> list[str]:
    """Numeric columns that may feed a model, in frame order (the run-time column set difference)."""
    skip = NOT_FEATURES | set(keys)
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, _NUMERIC)]


def feature_importance(train: DataFrame, feature_cols: Sequence[str], preset: Preset = CORRECTED,
                       params: Mapping[str, object] | None = None) -> DataFrame:
    """``(position, feature, importance)``, one row per input column, from a default forest (or one with
    the given parameters)."""
    rows = assemble(train.where(F.col("label").isNotNull()), feature_cols)
    forest = estimator("rf", params, preset) if params else RandomForestRegressor(seed=preset.seed, labelCol="label")
    model = forest.fit(rows)
    scores = model.featureImportances.toArray()
    schema = T.StructType([
        T.StructField("position", T.IntegerType(), False),
        T.StructField("feature", T.StringType(), False),
        T.StructField("importance", T.DoubleType(), False),
    ])
    data = [(i, name, float(s)) for i, (name, s) in enumerate(zip(feature_cols, scores))]
    return train.sparkSession.createDataFrame(data, schema)


def ranked(importance: DataFrame) -> DataFrame:
    """Importances, highest first (ties by input position)."""
    return importance.orderBy(F.desc("importance"), F.asc("position"))


def selected(importance: DataFrame, threshold: float = IMPORTANCE_THRESHOLD) -> DataFrame:
    """Rows of the columns kept, in input order."""
    return importance.where(F.col("importance") > F.lit(threshold)).orderBy("position")


def select_features(importance: DataFrame, threshold: float = IMPORTANCE_THRESHOLD) -> list[str]:
    """Names of the kept columns. The frame has one row per candidate column, so this collect is
    bounded by the width of the feature frame, not by the data."""
    names = [r["feature"] for r in selected(importance, threshold).select("feature").collect()]
    if not names:
        raise ValueError(f"no feature scores above {threshold}")
    return names
