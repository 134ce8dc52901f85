"""MLlib regressors and fitting (inventory I11-I16, I21).

Fits are MLlib's own distributed algorithms (tree histograms and normal equations aggregate on the
executors); the driver only holds the fitted model. Every randomised estimator gets a seed (S20).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Mapping, Sequence

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.config import CORRECTED, Preset
from weekcast.plans.linear import fit_elastic_net


def single(x: object) -> float:
    """The 32-bit float nearest to ``x``, as a double."""
    return struct.unpack("f", struct.pack("f", float(x)))[0]


def estimator(name: str, params: Mapping[str, object], preset: Preset = CORRECTED,
              features_col: str = "features", label_col: str = "label"):
    """Estimator for a model code and a parameter map whose keys follow the original's grids. Forests
    also take the optional ``MaxDepth``, ``Bootstrap`` and ``FeatureSubsetStrategy``; left out, MLlib's
    defaults hold, as in the original."""
    common = dict(featuresCol=features_col, labelCol=label_col, predictionCol="prediction")
    if name == "rf":
        optional = {k: v for k, v in (("maxDepth", params.get("MaxDepth")), ("bootstrap", params.get("Bootstrap")),
                                         ("featureSubsetStrategy", params.get("FeatureSubsetStrategy"))) if v is not None}
        return RandomForestRegressor(numTrees=int(params["NumTrees"]), maxBins=int(params["MaxBins"]),
                                     seed=preset.seed, **optional, **common)
    if name == "dt":
        return DecisionTreeRegressor(maxDepth=int(params["MaxDepth"]), maxBins=int(params["MaxBins"]),
                                     seed=preset.seed, **common)
    if name == "gbt":
        return GBTRegressor(maxIter=int(params["MaxIter"]), maxBins=int(params["MaxBins"]),
                            maxDepth=int(params["MaxDepth"]), seed=preset.seed, **common)
    if name == "lr":
        width = single if preset.single_penalties else float
        return LinearRegression(regParam=width(params["RegParam"]), elasticNetParam=width(params["ElasticNetParam"]), **common)
    raise ValueError(f"unknown model {name!r}; expected one of rf, dt, gbt, lr")


def assemble(df: DataFrame, feature_cols: Sequence[str], output: str = "features") -> DataFrame:
    """Named columns -> one vector column (I11). The label is never an input."""
    if "label" in feature_cols:
        raise ValueError("the label cannot be a model input")
    return VectorAssembler(inputCols=list(feature_cols), outputCol=output, handleInvalid="error").transform(df)


def fit(train: DataFrame, feature_cols: Sequence[str], name: str, params: Mapping[str, object], preset: Preset = CORRECTED):
    """A model fitted on assembled rows with a label. Linear models whose penalty has an L1 part are fitted at
    their optimum when the preset says so; all others are MLlib's."""
    if name == "lr" and preset.exact_elastic_net and float(params["RegParam"]) > 0 and float(params["ElasticNetParam"]) > 0:
        return fit_elastic_net(train, feature_cols, float(params["RegParam"]), float(params["ElasticNetParam"]))
    return estimator(name, params, preset).fit(train)


def fit_predict(
    train: DataFrame,
    test: DataFrame,
    feature_cols: Sequence[str],
    name: str,
    params: Mapping[str, object],
    preset: Preset = CORRECTED,
    keep: Sequence[str] = ("date", "label", "level"),
) -> DataFrame:
    """Fit on ``train`` (rows with a label), predict ``test``; returns ``keep`` columns + prediction."""
    train_rows = assemble(train.where(F.col("label").isNotNull()), feature_cols)
    model = fit(train_rows, feature_cols, name, params, preset)
    keep = [c for c in keep if c in test.columns]
    return model.transform(assemble(test, feature_cols)).select(*keep, "prediction")


#: the grid key along which one fit holds the models of all its smaller values
NESTED = {"gbt": "MaxIter", "dt": "MaxDepth"}


def _levels(root, depths: Sequence[int]) -> list[list[float]]:
    """For each depth, what a tree cut there predicts at each of its leaves, left to right."""
    out = [[] for _ in depths]
    stack = [(root, [])]
    while stack:
        node, above = stack.pop()
        path = [*above, float(node.prediction())]
        if node.getClass().getSimpleName() == "LeafNode":
            for values, depth in zip(out, depths):
                values.append(path[min(depth, len(path) - 1)])
        else:
            stack += [(node.rightChild(), path), (node.leftChild(), path)]
    return out


def staged_predictions(model, frame: DataFrame, name: str, stages: Sequence[int]) -> DataFrame:
    """``frame`` with a column ``stage_<s>`` for each of ``stages``: what a model fitted with that many boosting
    iterations (``gbt``) or that depth (``dt``) predicts, read off one fitted with at least as many.

    Boosting adds a tree to those before it, so its first trees are the shorter model. A split depends on the rows
    of its node alone, so a tree cut at a depth predicts what its nodes there hold; the model has at most 2^depth
    leaves, whose ancestors' predictions come from the driver's copy of the tree."""
    if name == "gbt":
        trees, weights = model.trees[: max(stages)], model.treeWeights
        named = {f"_tree_{i}": tree.setPredictionCol(f"_tree_{i}").setFeaturesCol(model.getFeaturesCol()) for i, tree in enumerate(trees)}
        out = frame
        for tree in named.values():
            out = tree.transform(out)
        total, sums = F.lit(0.0), {}
        for i, c in enumerate(named):
            total = total + F.col(c) * F.lit(float(weights[i]))
            sums[i + 1] = total
        return out.withColumns({f"stage_{s}": sums[s] for s in stages}).drop(*named)
    if name == "dt":
        leaf = model.copy().setLeafCol("_leaf").setPredictionCol("_cut").transform(frame)
        at = F.col("_leaf").cast("int") + 1
        levels = _levels(model._call_java("rootNode"), stages)
        return leaf.withColumns({f"stage_{s}": F.element_at(F.array(*map(F.lit, values)), at)
                                 for s, values in zip(stages, levels)}).drop("_leaf", "_cut")
    raise ValueError(f"fits of {name!r} are not nested")


def evaluate(pred: DataFrame, metric: str = "rmse") -> float:
    """One metric over rows with a label (I16); a single aggregate job."""
    scored = pred.where(F.col("label").isNotNull())
    return RegressionEvaluator(metricName=metric, labelCol="label", predictionCol="prediction").evaluate(scored)


def staged_scores(model, frame: DataFrame, name: str, stages: Sequence[int], metric: str = "rmse") -> dict[int, float]:
    """The metric of each of ``staged_predictions``. For boosting and the usual errors MLlib sums the loss after every
    iteration in one pass; otherwise each stage is evaluated by itself."""
    loss = {"rmse": "squared", "mse": "squared", "mae": "absolute"}.get(metric)
    if name == "gbt" and loss:
        errors = model.evaluateEachIteration(frame.where(F.col("label").isNotNull()), loss)
        return {s: math.sqrt(errors[s - 1]) if metric == "rmse" else errors[s - 1] for s in stages}
    staged = staged_predictions(model, frame, name, stages)
    return {s: evaluate(staged.withColumn("prediction", F.col(f"stage_{s}")), metric) for s in stages}


def linear_fit_coefficients(train: DataFrame, feature_cols: Sequence[str], label: str = "label") -> DataFrame:
    """Unpenalised least squares through MLlib's normal-equation solver, as a one-row frame
    ``(slope, intercept)`` (one feature) or ``(slope_<name>..., intercept)``."""
    rows = assemble(train.where(F.col(label).isNotNull()), feature_cols)
    model = LinearRegression(regParam=0.0, elasticNetParam=0.0, solver="normal", labelCol=label).fit(rows)
    spark: SparkSession = train.sparkSession
    coefs = [float(c) for c in model.coefficients]
    names = ["slope"] if len(coefs) == 1 else [f"slope_{c}" for c in feature_cols]
    return spark.createDataFrame([tuple(coefs) + (float(model.intercept),)], [*names, "intercept"])
