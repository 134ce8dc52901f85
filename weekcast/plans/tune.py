"""Hyper-parameter grids and chronological cross-validation (inventory I19, I20, I22, F4).

``pyspark.ml.tuning.CrossValidator`` trains every fold on all other folds, later rows included, so it
leaks the future; ``TrainValidationSplit`` splits at random. The folds here come from
``rolling_folds`` (train always precedes test) and every fit is an ordinary MLlib job. Sets that differ only in
the boosting iterations or in a tree's depth share one fit, that of the largest value: its first trees, or the
tree cut at the smaller depth, are the other models. The fold frame is assembled and evaluated once, and fits
are submitted from a driver thread pool, whose size is the one bound on fits in flight.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.config import CORRECTED, Preset
from weekcast.operators.split import TEST, TRAIN, rolling_folds
from weekcast.plans.models import NESTED, assemble, evaluate, fit, staged_scores
from weekcast.constants import CV_FOLDS
from weekcast.session import materialize, release

CV_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("param_ix", T.IntegerType(), False),
    T.StructField("params", T.StringType(), False),
    T.StructField("fold", T.IntegerType(), False),
    T.StructField("n_train", T.LongType(), False),
    T.StructField("n_test", T.LongType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("score", T.DoubleType(), True),
])


def param_grid(grid: Mapping[str, Sequence[object]]) -> list[dict[str, object]]:
    """Cartesian product of a small driver-side grid, first key slowest."""
    names = list(grid)
    return [dict(zip(names, combo)) for combo in itertools.product(*(grid[n] for n in names))]


def families(name: str, sets: Sequence[Mapping[str, object]]) -> list[list[int]]:
    """Indexes of the parameter sets that one fit can answer: equal but for the model's nested key, that of the
    largest value first. Sets without that key, and models without one, stand alone."""
    key, groups = NESTED.get(name), {}
    for ix, params in enumerate(sets):
        alone = key not in params
        rest = (ix,) if alone else tuple(sorted((k, str(v)) for k, v in params.items() if k != key))
        groups.setdefault((alone, rest), []).append(ix)
    return [sorted(g, key=lambda ix: -int(sets[ix][key]) if key in sets[ix] else 0) for g in groups.values()]


def in_parallel(run, tasks: Sequence, parallelism: int) -> list:
    """``[run(t) for t in tasks]`` from a pool of driver threads that keep the caller's job group and
    scheduler pool."""
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(run), t) for t in tasks]]


def rolling_cv(
    train: DataFrame,
    feature_cols: Sequence[str],
    name: str,
    grid: Mapping[str, Sequence[object]] | Sequence[Mapping[str, object]],
    folds: int = CV_FOLDS,
    gap: int = 0,
    keys: Sequence[str] = (),
    preset: Preset = CORRECTED,
    metric: str = "rmse",
    parallelism: int = 8,
    nested: bool = True,
) -> DataFrame:
    """One row per (parameter set, fold): sizes and the metric on the fold's test rows.

    ``gap`` rows between each fold's train and test (expanding origin only). Raises if a fold has no
    training rows (the original's fixed origin does when the row count is a multiple of 10). ``nested=False``
    fits every set on its own; the scores are the same.
    """
    sets = param_grid(grid) if isinstance(grid, Mapping) else [dict(p) for p in grid]
    groups = families(name, sets) if nested else [[ix] for ix in range(len(sets))]
    assignments = rolling_folds(train.where(F.col("label").isNotNull()), folds, gap, keys, preset)
    fold_frame = materialize(assemble(assignments, feature_cols))
    parts: dict[tuple[int, str], DataFrame] = {}
    try:
        sizes = {(r["fold"], r["role"]): r["n"] for r in
                 fold_frame.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n")).collect()}
        for f in range(1, folds + 1):
            if not sizes.get((f, TRAIN)):
                raise ValueError(f"fold {f} has no training rows")
            if not sizes.get((f, TEST)):
                raise ValueError(f"fold {f} has no test rows")
        # every fit of a fold reads its own rows, not the whole fold frame
        parts = {(f, role): fold_frame.where((F.col("fold") == f) & (F.col("role") == role)).persist(StorageLevel.MEMORY_AND_DISK)
                 for f in range(1, folds + 1) for role in (TRAIN, TEST)}

        def run(task):
            group, f = task
            model = fit(parts[f, TRAIN], feature_cols, name, sets[group[0]], preset)
            if len(group) == 1:
                scores = {group[0]: evaluate(model.transform(parts[f, TEST]), metric)}
            else:
                stages = {ix: int(sets[ix][NESTED[name]]) for ix in group}
                staged = staged_scores(model, parts[f, TEST], name, sorted(set(stages.values())), metric)
                scores = {ix: staged[s] for ix, s in stages.items()}
            return [(name, ix, json.dumps(sets[ix], sort_keys=True), f, sizes[(f, TRAIN)], sizes[(f, TEST)], metric, float(score))
                    for ix, score in scores.items()]

        # deep trees first, so that the pool doesn't end on a long fit
        deep = sorted(groups, key=lambda g: -int(sets[g[0]].get("MaxDepth", 0)))
        tasks = [(g, f) for g in deep for f in range(1, folds + 1)]
        rows = [row for some in in_parallel(run, tasks, parallelism) for row in some]
    finally:
        for part in parts.values():
            part.unpersist()
        release(fold_frame)
    return train.sparkSession.createDataFrame(sorted(rows, key=lambda r: (r[1], r[3])), CV_SCHEMA)


def cv_summary(cv_results: DataFrame) -> DataFrame:
    """Mean score per parameter set, best first; ties go to the earlier set in grid order."""
    return (
        cv_results.groupBy("model", "param_ix", "params")
        .agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("folds"))
        .orderBy("mean_score", "param_ix")
    )


def best_params(cv_results: DataFrame) -> dict[str, object]:
    """Parameter map of the best set (I22); one row comes back."""
    best = cv_summary(cv_results).first()
    return json.loads(best["params"])
