"""Models, importance selection, CV and the report (I10-I26; S12, S20, S21)."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from weekcast.config import CORRECTED, REFERENCE
from weekcast.plans.models import NESTED, assemble, estimator, evaluate, fit_predict, linear_fit_coefficients, staged_predictions
from weekcast.plans.report import accuracy_table, compare, prepare_horizon, run_model
from weekcast.plans.select import NOT_FEATURES, candidate_columns, selected
from weekcast.constants import PARAM_GRIDS
from weekcast.plans.tune import best_params, cv_summary, families, param_grid, rolling_cv
from weekcast.queries import panel


@pytest.fixture(scope="module")
def h1(spark):
    return prepare_horizon(panel(spark, SF_SMALL), 1, (), REFERENCE)


def test_param_grid_order():
    g = param_grid(PARAM_GRIDS["gbt"])
    assert len(g) == 27
    assert g[0] == {"MaxIter": "5", "MaxBins": "23", "MaxDepth": "6"}
    assert g[1] == {"MaxIter": "5", "MaxBins": "23", "MaxDepth": "8"}
    assert g[-1] == {"MaxIter": "10", "MaxBins": "27", "MaxDepth": "10"}


def test_label_never_an_input(h1, spark):
    assert "label" not in h1.features and "level" not in h1.features
    assert not set(candidate_columns(h1.frame)) & NOT_FEATURES
    with pytest.raises(ValueError):
        assemble(h1.frame, ["diff_sales", "label"])
    imp = h1.importance.collect()
    assert sum(r["importance"] for r in imp) == pytest.approx(1.0)
    assert [r["feature"] for r in selected(h1.importance).collect()] == h1.features


def test_seeded_fits_repeat(h1):
    for name, params in (("rf", {"NumTrees": "5", "MaxBins": "28"}), ("gbt", {"MaxIter": "5", "MaxBins": "23", "MaxDepth": "6"}),
                         ("dt", {"MaxDepth": "5", "MaxBins": "20"}), ("lr", {"RegParam": "0.1", "ElasticNetParam": "0"})):
        a = evaluate(fit_predict(h1.train, h1.test, h1.features, name, params, REFERENCE))
        b = evaluate(fit_predict(h1.train, h1.test, h1.features, name, params, REFERENCE))
        assert a == b, name


def test_trees_beat_the_mean_on_train(h1):
    train = h1.train
    mean = train.agg(F.avg("label")).first()[0]
    base = evaluate(train.withColumn("prediction", F.lit(mean)))
    fit = evaluate(fit_predict(train, train, h1.features, "dt", {"MaxDepth": "5", "MaxBins": "20"}, REFERENCE))
    assert fit < base


def test_linear_fit_matches_closed_form(h1):
    coef = linear_fit_coefficients(h1.train, ["diff_sales"]).first()
    m = h1.train.agg(F.regr_slope("label", "diff_sales").alias("s"), F.regr_intercept("label", "diff_sales").alias("i")).first()
    assert coef["slope"] == pytest.approx(m["s"], rel=1e-9)
    assert coef["intercept"] == pytest.approx(m["i"], rel=1e-9)


def test_cv_grid_of_one_is_a_plain_fit(h1):
    params = {"MaxDepth": "5", "MaxBins": "20"}
    cv = rolling_cv(h1.train, h1.features, "dt", [params], 2, 5, (), CORRECTED)
    rows = cv.collect()
    assert len(rows) == 2 and all(json.loads(r["params"]) == params for r in rows)
    assert best_params(cv) == params
    assert cv_summary(cv).first()["folds"] == 2


def test_cv_ties_go_to_the_first_set(spark):
    from weekcast.plans.tune import CV_SCHEMA

    rows = [("dt", 0, json.dumps({"a": 1}), 1, 5, 5, "rmse", 2.0), ("dt", 1, json.dumps({"a": 2}), 1, 5, 5, "rmse", 2.0),
            ("dt", 2, json.dumps({"a": 3}), 1, 5, 5, "rmse", 3.0)]
    assert best_params(spark.createDataFrame(rows, CV_SCHEMA)) == {"a": 1}


def test_fixed_origin_cv_fails_on_empty_train(make_series):
    import numpy as np

    vals = list(np.round(1e6 + np.random.default_rng(0).normal(0, 1e5, 60)))
    df = make_series(vals).withColumns({"label": F.col("total_sales"), "x": F.col("total_sales") * 2})
    with pytest.raises(ValueError, match="no training rows"):
        rolling_cv(df, ["x"], "lr", [{"RegParam": "0", "ElasticNetParam": "0"}], 2, 0, (), REFERENCE)


def test_reference_penalties_have_the_originals_width(spark):
    params = {"RegParam": "0.1", "ElasticNetParam": "0.5"}
    assert estimator("lr", params, REFERENCE).getRegParam() == 0.10000000149011612
    assert estimator("lr", params, CORRECTED).getRegParam() == 0.1


def test_unknown_model():
    with pytest.raises(ValueError):
        estimator("svm", {})


def test_run_model_and_table(spark):
    p = panel(spark, SF_SMALL)
    small = {"rf": {"NumTrees": ["5"], "MaxBins": ["28"]}, "gbt": {"MaxIter": ["5"], "MaxBins": ["23"], "MaxDepth": ["6"]}}
    long, runs = compare(p, horizons=(1, 2), models=("rf", "lr"), preset=CORRECTED, grids=small)
    table = accuracy_table(long, (1, 2)).collect()
    assert [r["model"] for r in table] == ["SMA", "Random Forest", "Linear Regression"]
    assert table[0]["1 week"] is None and table[0]["2 weeks"] is not None
    assert all(0 <= r["2 weeks"] <= 200 for r in table)
    rf1 = [r for r in runs if r.model == "rf" and r.h == 1][0]
    assert rf1.cv is not None and rf1.params == {"NumTrees": "5", "MaxBins": "28"}
    n_test = prepare_horizon(p, 1, (), CORRECTED).test.count()
    assert rf1.predictions.count() == n_test


def test_keyed_global_model(spark):
    keys = ("nation",)
    p = panel(spark, SF_SMALL, keys)
    data = prepare_horizon(p, 1, keys, CORRECTED)
    assert "nation" not in data.features
    run = run_model(data, "lr", {"RegParam": "0.1", "ElasticNetParam": "0"}, keys=keys, preset=CORRECTED)
    per_key = run.score.collect()
    assert len(per_key) == p.select("nation").distinct().count()
    assert all(r["smape"] is None or 0 <= r["smape"] <= 200 for r in per_key)
    assert run.predictions.count() == data.test.count()


def test_series_features_come_from_the_series_own_train_rows(spark):
    keys = ("nation",)
    data = prepare_horizon(panel(spark, SF_SMALL, keys), 1, keys, CORRECTED, feature_cols=["series_mean", "series_std"])
    rows = data.frame.select("nation", "role", "diff_sales", "series_mean").collect()
    for nation in {r["nation"] for r in rows}:
        train = [r["diff_sales"] for r in rows if r["nation"] == nation and r["role"] == "train"]
        means = {r["series_mean"] for r in rows if r["nation"] == nation}
        assert len(means) == 1 and means.pop() == pytest.approx(sum(train) / len(train) if train else 0.0)


def test_parallelism_bounds_the_fits_in_flight(spark, monkeypatch):
    import threading
    import time

    from weekcast.plans import report, tune

    flying, most, lock = [0], [0], threading.Lock()

    def counted(real):
        def fit(*args, **kwargs):
            with lock:
                flying[0] += 1
                most[0] = max(most[0], flying[0])
            try:
                time.sleep(0.05)
                return real(*args, **kwargs)
            finally:
                with lock:
                    flying[0] -= 1
        return fit

    monkeypatch.setattr(report, "fit_predict", counted(report.fit_predict))
    monkeypatch.setattr(tune, "evaluate", counted(tune.evaluate))
    grid = {"lr": {"RegParam": ["0", "0.1", "0.5"], "ElasticNetParam": ["0"]}, "dt": {"MaxDepth": ["2"], "MaxBins": ["20"]}}
    compare(panel(spark, SF_SMALL), horizons=(1, 2), models=("lr", "dt"), preset=CORRECTED, grids=grid,
            pinned={("dt", 1): {"MaxDepth": "2", "MaxBins": "20"}, ("dt", 2): {"MaxDepth": "2", "MaxBins": "20"}}, parallelism=2)
    assert most[0] <= 2


def test_materialize_without_a_shared_folder_persists(spark, monkeypatch):
    from weekcast import session

    monkeypatch.setattr(session, "_shared_folder", lambda s: None)
    held = session.materialize(spark.range(5))
    assert held.is_cached and held.count() == 5
    session.release(held)
    assert not held.is_cached


def test_keyed_comparison(spark):
    keys = ("nation",)
    p = panel(spark, SF_SMALL, keys)
    one = {"lr": {"RegParam": ["0.1"], "ElasticNetParam": ["0"]}}
    long, runs = compare(p, horizons=(2,), models=("lr",), preset=CORRECTED, pinned={}, grids=one, keys=keys)
    table = accuracy_table(long, (2,), keys).collect()
    n_series = p.select("nation").distinct().count()
    assert len(table) == 2 * n_series
    assert {r["model"] for r in table} == {"SMA", "Linear Regression"}
    assert runs[0].params == {"RegParam": "0.1", "ElasticNetParam": "0"}


def test_unpenalised_linear_model_equals_numpy_least_squares(h1):
    import numpy as np

    cols = ["diff_sales", "lag_1week", "temp", "month"]
    params = {"RegParam": "0", "ElasticNetParam": "0"}
    pred = fit_predict(h1.train, h1.test, cols, "lr", params, REFERENCE).orderBy("date").collect()
    train = h1.train.select(*cols, "label").collect()
    X = np.array([[r[c] for c in cols] + [1.0] for r in train])
    y = np.array([r["label"] for r in train])
    coef, *_ = np.linalg.lstsq(X, y, rcond=None)
    test = h1.test.orderBy("date").select(*cols).collect()
    expected = np.array([[r[c] for c in cols] + [1.0] for r in test]) @ coef
    got = np.array([r["prediction"] for r in pred])
    assert np.allclose(got, expected, rtol=1e-6, atol=1e-3 * np.abs(y).mean())


def _best_stump(x, y):
    """Exhaustive least-squares split x <= t over every gap between distinct values."""
    import numpy as np

    order = np.argsort(x)
    xs, ys = x[order], y[order]
    best = None
    for i in range(1, len(xs)):
        if xs[i] == xs[i - 1]:
            continue
        left, right = ys[:i], ys[i:]
        sse = ((left - left.mean()) ** 2).sum() + ((right - right.mean()) ** 2).sum()
        if best is None or sse < best[0]:
            best = (sse, xs[i - 1], left.mean(), right.mean())
    _, t, lo, hi = best
    return np.where(x <= t, lo, hi)


@pytest.mark.parametrize("name,params", [("dt", {"MaxDepth": "1", "MaxBins": "1000"}),
                                         ("gbt", {"MaxIter": "1", "MaxDepth": "1", "MaxBins": "1000"})])
def test_depth_one_trees_equal_the_exhaustive_stump(h1, name, params):
    import numpy as np

    train = h1.train.orderBy("date")
    rows = train.select("diff_sales", "label").collect()
    x = np.array([r["diff_sales"] for r in rows])
    y = np.array([r["label"] for r in rows])
    got = np.array([r["prediction"] for r in
                    fit_predict(train, train, ["diff_sales"], name, params, REFERENCE).orderBy("date").collect()])
    assert np.allclose(got, _best_stump(x, y), rtol=1e-9)


def test_rolling_cv_equals_brute_force_per_fold(spark):
    import numpy as np

    data = prepare_horizon(panel(spark, SF_SMALL), 1, (), CORRECTED, feature_cols=["diff_sales", "lag_1week"])
    gap = 5
    cv = rolling_cv(data.train, data.features, "lr", [{"RegParam": "0", "ElasticNetParam": "0"}], 2, gap, (), CORRECTED)
    got = {r["fold"]: (r["n_train"], r["n_test"], r["score"]) for r in cv.collect()}
    rows = data.train.orderBy("date").select("diff_sales", "lag_1week", "label").collect()
    X = np.array([[r["diff_sales"], r["lag_1week"], 1.0] for r in rows])
    y = np.array([r["label"] for r in rows])
    n = len(rows)
    for fold in (1, 2):
        b, e = fold * n // 3, (fold + 1) * n // 3
        coef, *_ = np.linalg.lstsq(X[: b - gap], y[: b - gap], rcond=None)
        rmse = float(np.sqrt(np.mean((X[b:e] @ coef - y[b:e]) ** 2)))
        assert got[fold][:2] == (b - gap, e - b)
        assert got[fold][2] == pytest.approx(rmse, rel=1e-6)


def test_forest_predictions_do_not_depend_on_shuffle_settings(spark):
    """Single-series frames end in one partition and fits are seeded, so bagging sees the same rows."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for parts in ("3", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            data = prepare_horizon(panel(spark, SF_SMALL), 1, (), REFERENCE)
            run = run_model(data, "rf", {"NumTrees": "5", "MaxBins": "28"}, preset=REFERENCE)
            out.append([(r["date"], r["prediction"]) for r in run.predictions.orderBy("date").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]


def test_reference_comparison_path(spark):
    """Series-tail baseline, fixed-origin CV and trimmed scoring, on a one-set grid."""
    p = panel(spark, SF_SMALL)
    one = {"dt": {"MaxDepth": ["5"], "MaxBins": ["20"]}}
    long, runs = compare(p, horizons=(2,), models=("dt",), preset=REFERENCE, pinned={}, grids=one)
    rows = {r["model"]: r["2 weeks"] for r in accuracy_table(long, (2,)).collect()}
    assert set(rows) == {"SMA", "Decision Tree"} and all(0 <= v <= 200 for v in rows.values())
    cv = runs[0].cv.collect()
    assert len(cv) == 2 and all(r["n_train"] < r["n_test"] for r in cv)   # the fixed origin trains on n % 10 rows


# -- nested fits ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "grid"), [
    ("gbt", {"MaxIter": ["1", "3", "6"], "MaxBins": ["20"], "MaxDepth": ["2", "4"]}),
    ("dt", {"MaxDepth": ["0", "1", "3", "9"], "MaxBins": ["20", "25"]}),
    ("rf", {"NumTrees": ["2", "3"], "MaxBins": ["20"]}),
])
@pytest.mark.parametrize("metric", ["rmse", "mae", "r2"])
def test_nested_fits_score_like_separate_fits(spark, name, grid, metric):
    data = prepare_horizon(panel(spark, SF_SMALL), 1, (), CORRECTED, feature_cols=["diff_sales", "lag_1week", "month", "day", "std_4weeks"])
    scores = {nested: [tuple(r) for r in rolling_cv(data.train, data.features, name, grid, 2, 5, (), CORRECTED, metric, nested=nested).collect()]
              for nested in (True, False)}
    assert len(scores[True]) == 2 * len(param_grid(grid))
    for a, b in zip(scores[True], scores[False]):
        assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1], rel=1e-12)


def test_families_share_all_but_the_nested_key():
    sets = param_grid(PARAM_GRIDS["gbt"])
    groups = families("gbt", sets)
    assert len(groups) == 9 and sorted(ix for g in groups for ix in g) == list(range(27))
    assert all(sets[g[0]]["MaxIter"] == "10" and len({(sets[ix]["MaxBins"], sets[ix]["MaxDepth"]) for ix in g}) == 1 for g in groups)
    assert [len(g) for g in families("dt", param_grid(PARAM_GRIDS["dt"]))] == [3, 3, 3]
    assert families("lr", [{"a": 1}, {"a": 2}]) == [[0], [1]]
    assert families("dt", [{"MaxBins": "20"}, {"MaxDepth": "2", "MaxBins": "20"}, {"MaxDepth": "9", "MaxBins": "20"}]) == [[0], [2, 1]]


@pytest.mark.parametrize("name", ["gbt", "dt"])
def test_staged_predictions_equal_models_of_that_size(h1, name):
    key, most = NESTED[name], 6
    base = {"MaxIter": most, "MaxBins": "20", "MaxDepth": 4 if name == "gbt" else most}
    train = assemble(h1.train.where(F.col("label").isNotNull()), h1.features)
    test = assemble(h1.test, h1.features)
    staged = staged_predictions(estimator(name, base).fit(train), test, name, [1, 2, most])
    assert {"stage_1", "stage_2", f"stage_{most}"} <= set(staged.columns) and not {"_leaf", "_cut"} & set(staged.columns)
    for s in (1, 2, most):
        alone = estimator(name, {**base, key: s}).fit(train).transform(test)
        want = {r.date: r.prediction for r in alone.select("date", "prediction").collect()}
        for r in staged.select("date", f"stage_{s}").collect():
            assert r[1] == pytest.approx(want[r.date], rel=1e-12)


# -- elastic net ---------------------------------------------------------------------------------------------


def _coordinate_descent(gram, cross, l1, l2, sweeps):
    import numpy as np

    b = np.linalg.solve(gram + l2 * np.eye(len(cross)), cross)
    for _ in range(sweeps):
        for j in range(len(cross)):
            r = cross[j] - gram[j] @ b + gram[j, j] * b[j]
            b[j] = np.sign(r) * max(abs(r) - l1, 0.0) / (gram[j, j] + l2)
    return b


@pytest.mark.parametrize("fold", [1, 2])
def test_elastic_net_reaches_the_optimum_on_the_corrected_folds(spark, fold):
    """All grid sets with an L1 part, on inputs of which the moving means are combinations of the lags."""
    import numpy as np

    from weekcast.operators.split import purge_gap, rolling_folds
    from weekcast.plans.linear import feature_sign, fit_elastic_net, moments, objective

    data = prepare_horizon(panel(spark, SF_MID), 1, (), CORRECTED)
    assert {"ma_1week", "ma_2weeks", "lag_1week", "lag_2weeks"} <= set(data.features)
    folds = rolling_folds(data.train.where("label is not null"), 2, purge_gap(1), (), CORRECTED)
    train = folds.where((F.col("fold") == fold) & (F.col("role") == "train")).persist()
    m = moments(train, data.features)
    rows = np.array([[float(r[c]) for c in [*data.features, "label"]] for r in train.collect()])
    assert m.n == len(rows) and np.allclose(m.std, rows.std(0)) and np.allclose(m.corr, np.corrcoef(rows.T), atol=1e-12)
    k = len(data.features)
    z, t = (rows[:, :k] - rows[:, :k].mean(0)) / rows[:, :k].std(0), (rows[:, k] - rows[:, k].mean()) / rows[:, k].std()
    gram, cross = z.T @ z / len(t), z.T @ t / len(t)
    for penalty in (0.1, 0.5):
        for mix in (0.1, 0.5):
            l1, l2 = penalty / rows[:, k].std() * mix, penalty / rows[:, k].std() * (1 - mix)
            found = fit_elastic_net(train, data.features, penalty, mix)
            b = np.array([found.coefficients[c] for c in data.features]) * rows[:, :k].std(0) / rows[:, k].std()
            assert objective(b, gram, cross, l1, l2) <= objective(_coordinate_descent(gram, cross, l1, l2, 3000), gram, cross, l1, l2) + 1e-8
            slope = cross - gram @ b - l2 * b  # the conditions of the optimum
            assert np.all(np.abs(slope) <= l1 + 1e-9) and np.allclose(slope[b != 0], l1 * np.sign(b[b != 0]), atol=1e-9)
            exact = feature_sign(m.corr[:k, :k], m.corr[:k, k], l1, l2)
            assert objective(exact, gram, cross, l1, l2) == pytest.approx(objective(b, gram, cross, l1, l2), abs=1e-10)
            got = np.array([r.prediction for r in found.transform(train).collect()])
            assert np.allclose(got, rows[:, k].mean() + (z @ b) * rows[:, k].std(), rtol=1e-8)
    train.unpersist()


def test_elastic_net_beats_nothing_and_handles_constants(spark):
    from weekcast.plans.linear import fit_elastic_net

    df = spark.createDataFrame([(float(i), 1.0, 2.0 * i, float(3 * i + i % 2)) for i in range(20)], "x double, one double, twice double, label double")
    strong = fit_elastic_net(df, ["x", "one", "twice"], 1e9, 0.5)
    assert set(strong.coefficients.values()) == {0.0} and strong.intercept == pytest.approx(29.0)
    lasso = fit_elastic_net(df, ["x", "one", "twice"], 1e-6, 1.0)
    assert lasso.coefficients["one"] == 0.0 and lasso.coefficients["twice"] == 0.0 and lasso.coefficients["x"] == pytest.approx(3.0, rel=1e-2)
    flat = fit_elastic_net(df.withColumn("label", F.lit(5.0)), ["x"], 0.1, 0.5)
    assert flat.coefficients == {"x": 0.0} and flat.intercept == 5.0
    with pytest.raises(ValueError, match="two rows"):
        fit_elastic_net(df.limit(1), ["x"], 0.1, 0.5)


def test_independent_columns():
    import numpy as np

    from weekcast.plans.linear import feature_sign, independent, objective

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    x = np.c_[x, x[:, 0] + x[:, 1], rng.normal(size=200), x[:, 2] * -2]
    assert independent(np.corrcoef(x.T)) == [0, 1, 2, 4]
    for seed in range(20):  # random problems against long coordinate descent
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(30, 6)) @ rng.normal(size=(6, 6))
        g = np.corrcoef(np.c_[x, x @ rng.normal(size=6) + rng.normal(size=30)].T)
        l1, l2 = rng.uniform(0.001, 0.5), rng.uniform(1e-4, 0.1)
        args = (g[:6, :6], g[:6, 6], l1, l2)
        assert objective(feature_sign(*args), *args) <= objective(_coordinate_descent(*args, 3000), *args) + 1e-9


def test_cv_of_the_elastic_net_uses_the_optimum(spark):
    """Scores of the reference's iterations and of the optimum differ only where the penalty has an L1 part."""
    data = prepare_horizon(panel(spark, SF_SMALL), 1, (), CORRECTED, feature_cols=["diff_sales", "lag_1week", "lag_2weeks", "ma_1week"])
    grid = {"RegParam": ["0.5"], "ElasticNetParam": ["0", "0.5"]}
    exact = [r.score for r in rolling_cv(data.train, data.features, "lr", grid, 2, 5, (), CORRECTED).collect()]
    mllib = [r.score for r in rolling_cv(data.train, data.features, "lr", grid, 2, 5, (), CORRECTED.with_(exact_elastic_net=False)).collect()]
    assert exact[:2] == mllib[:2] and exact[2:] == pytest.approx(mllib[2:], rel=0.05)
