"""Feature builder, split, gap and folds (B6-B8, E1-E9, I3-I9, I20; S2-S7, S10, S11, S13, S25)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import weekly_dates
from weekcast.config import CORRECTED, REFERENCE
from weekcast.operators.features import build_features, feature_names, seasonal_diff
from weekcast.operators.split import purge_gap, rolling_folds, split_frame, ts_split


def _series(n, seed=0, level=1e6):
    rng = np.random.default_rng(seed)
    return list(np.round(level + rng.normal(0, level / 5, n)))


def test_sizes_of_a_143_week_series(make_series):
    """The original's 143 weekly rows: feature rows, train before and after the gap, test."""
    panel = make_series(_series(143, seed=1))
    expected = {1: (90, 72, 67, 18), 2: (89, 72, 65, 17), 3: (88, 71, 62, 17)}
    for h, (rows, train, purged, test) in expected.items():
        f = build_features(panel, h, (), REFERENCE)
        assert f.count() == rows
        s = split_frame(f, 0.8, purge_gap(h), (), REFERENCE)
        roles = {r["role"]: r["n"] for r in s.groupBy("role").agg(F.count("*").alias("n")).collect()}
        assert roles["train"] + roles["gap"] == train
        assert roles["train"] == purged
        assert roles["test"] == test


def test_filters_sit_between_window_steps(make_series):
    """A zero difference in the middle drops out under "positive" warm-up and the later lags slide."""
    vals = _series(80, seed=2)
    vals[60] = vals[12]      # difference 0 at row 60
    panel = make_series(vals)
    ref = build_features(panel, 1, (), REFERENCE)
    idx = build_features(panel, 1, (), CORRECTED)
    assert idx.count() == 80 - 48 - 4 - 1
    # the row whose oldest lag is that 0 (4 weeks later) is dropped; the zero row itself stays
    assert ref.count() == idx.count() - 1
    zero_day = weekly_dates(80)[60]
    dropped = weekly_dates(80)[64]
    assert ref.where(F.col("date") == dropped).count() == 0
    assert idx.where(F.col("date") == dropped).count() == 1
    assert ref.where(F.col("date") == zero_day).first()["diff_sales"] == 0


def test_corrected_preset(make_series):
    vals = _series(70, seed=3)
    f = build_features(make_series(vals), 2, (), CORRECTED).orderBy("date").collect()
    # signed difference, labels null past the end, level of the forecast row
    assert any(r["diff_sales"] < 0 for r in f)
    assert [r["label"] for r in f[-2:]] == [None, None]
    first = f[0]
    t = 48 + 2 + 3 + 1       # 0-based position of the first kept row
    assert first["diff_sales"] == vals[t] - vals[t - 48]
    assert first["label"] == vals[t + 2] - vals[t + 2 - 48]
    assert first["level"] == vals[t + 2 - 48]
    # retrend of the exact label restores the value h weeks ahead
    assert first["label"] + first["level"] == vals[t + 2]


def test_reference_preset_label_fill_and_level(make_series):
    vals = _series(70, seed=4)
    f = build_features(make_series(vals), 3, (), REFERENCE).orderBy("date").collect()
    assert [r["label"] for r in f[-3:]] == [0, 0, 0]
    assert all(r["diff_sales"] >= 0 for r in f)
    t = 48 + 3 + 3 + 1
    assert f[0]["level"] == vals[t - 48]


def test_feature_names():
    assert feature_names(2)[:4] == ["lag_2weeks", "lag_3weeks", "lag_4weeks", "lag_5weeks"]
    assert feature_names(1)[4] == "ma_1week"


def test_keyed_features_equal_per_key_runs(make_series):
    a, b = make_series(_series(75, 5), key="a"), make_series(_series(90, 6), key="b")
    both = build_features(a.unionByName(b), 1, ["key"], CORRECTED)
    for part, key in ((a, "a"), (b, "b")):
        single = build_features(part.drop("key"), 1, (), CORRECTED)
        x = sorted(tuple(r) for r in both.where(F.col("key") == key).drop("key").collect())
        y = sorted(tuple(r) for r in single.collect())
        assert x == y


def test_independent_of_partitioning(make_series):
    panel = make_series(_series(120, 7))
    base = sorted(tuple(r) for r in build_features(panel, 1, (), CORRECTED).collect())
    shuffled = sorted(tuple(r) for r in build_features(panel.repartition(7), 1, (), CORRECTED).collect())
    assert base == shuffled
    s1 = sorted(tuple(r) for r in split_frame(panel.repartition(5), 0.8, 3).collect())
    s2 = sorted(tuple(r) for r in split_frame(panel.coalesce(1), 0.8, 3).collect())
    assert s1 == s2


def test_split_is_chronological_with_gap(make_series):
    panel = make_series(_series(100, 8))
    s = split_frame(panel, 0.8, 7).collect()
    train = [r["date"] for r in s if r["role"] == "train"]
    gap = [r["date"] for r in s if r["role"] == "gap"]
    test = [r["date"] for r in s if r["role"] == "test"]
    assert len(train) == 73 and len(gap) == 7 and len(test) == 20
    assert max(train) < min(gap) <= max(gap) < min(test)
    tr, te = ts_split(panel, 0.8)
    assert tr.count() == 80 and te.count() == 20


def test_split_size_exact_vs_double(spark):
    """ceil(n * 0.8) in doubles can round a whole product up; exact decimals do not."""
    from weekcast.operators.split import split_size

    row = spark.range(1).select(split_size(F.lit(4000005), 0.7, True).alias("e"),
                                split_size(F.lit(4000005), 0.7, False).alias("d")).first()
    assert row["e"] == 2800004
    assert row["d"] == int(np.ceil(4000005 * 0.7))


def test_expanding_folds(make_series):
    panel = make_series(_series(90, 9))
    folds = rolling_folds(panel, 2, 3, (), CORRECTED).collect()
    for f in (1, 2):
        tr = sorted(r["row_ix"] for r in folds if r["fold"] == f and r["role"] == "train")
        te = sorted(r["row_ix"] for r in folds if r["fold"] == f and r["role"] == "test")
        assert tr == list(range(1, 30 * f - 3 + 1))
        assert te == list(range(30 * f + 1, 30 * (f + 1) + 1))


def test_fixed_origin_folds_reproduce_float_rounding(make_series):
    """The original: first n % 10 rows train, share as a 32-bit float; 37 rows -> 7/37 rounds up."""
    panel = make_series(_series(67, 10))
    folds = rolling_folds(panel, 2, 0, (), REFERENCE).collect()
    n, initial = 67, 7
    shift = (n - initial) // 2
    for f in (1, 2):
        total = initial + shift * f
        share = np.float32(initial) / np.float32(total)
        cut = int(np.ceil(total * float(share)))
        tr = [r for r in folds if r["fold"] == f and r["role"] == "train"]
        te = [r for r in folds if r["fold"] == f and r["role"] == "test"]
        assert len(tr) == cut and len(te) == total - cut
    assert int(np.ceil(37 * float(np.float32(7) / np.float32(37)))) == 8


def test_seasonal_diff_rejects_long_horizon(make_series):
    with pytest.raises(ValueError):
        seasonal_diff(make_series(_series(60, 11)), (), CORRECTED, h=48)


def test_fill_weeks_gives_calendar_lags(spark, make_series):
    from weekcast.operators.panel import fill_weeks

    vals = _series(80, seed=12)
    dates = weekly_dates(80)
    panel = make_series(vals).where(F.col("date") != F.lit(dates[60]))      # week 60 missing
    filled = fill_weeks(panel)
    assert filled.count() == 80 and filled.where(F.col("total_sales").isNull()).count() == 1
    f = {r["date"]: r for r in build_features(filled, 1, (), CORRECTED).collect()}
    # rows whose lags reach the missing week are dropped; the others use calendar lags
    for k in range(1, 5):
        assert dates[60 + k] not in f
    assert dates[60] not in f
    r = f[dates[70]]
    assert r["lag_1week"] == vals[69] - vals[69 - 48]
    # without filling, the row after the gap lags over it (row semantics, the default)
    rows = {r["date"]: r for r in build_features(panel, 1, (), CORRECTED).collect()}
    assert rows[dates[61]]["lag_1week"] == vals[59] - vals[59 - 48]


def test_index_warmup_on_a_bare_difference_series(make_series):
    from weekcast.operators.features import lag_features

    df = lag_features(make_series(list(range(1, 11)), column="diff_sales"), 2, (), CORRECTED)
    assert df.count() == 10 - (2 + 3)
