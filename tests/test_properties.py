"""Closed-form properties checked over many series at once: one key per case, one Spark job per test."""

import datetime as dt
import math
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weekcast.config import CORRECTED, REFERENCE
from weekcast.operators.evaluate import smape
from weekcast.operators.split import rolling_folds, split_frame

D0 = dt.date(2000, 1, 3)


def _many_series(spark, lengths):
    rows = [(k, D0 + dt.timedelta(weeks=i), float(i)) for k, n in enumerate(lengths) for i in range(n)]
    return spark.createDataFrame(rows, "key int, date date, total_sales double")


@pytest.mark.parametrize("pct,gap", [(0.8, 0), (0.8, 5), (0.7, 9), (0.75, 3)])
def test_split_sizes_closed_form(spark, pct, gap):
    lengths = list(range(1, 151))
    s = split_frame(_many_series(spark, lengths), pct, gap, ["key"], CORRECTED)
    got = {(r["key"], r["role"]): r["n"] for r in s.groupBy("key", "role").agg(F.count("*").alias("n")).collect()}
    order = s.groupBy("key").agg(
        F.max(F.when(F.col("role") == "train", F.col("date"))).alias("last_train"),
        F.min(F.when(F.col("role") == "test", F.col("date"))).alias("first_test")).collect()
    for k, n in enumerate(lengths):
        cut = math.ceil(Decimal(str(pct)) * n)
        assert got.get((k, "train"), 0) == max(0, cut - gap)
        assert got.get((k, "gap"), 0) == min(gap, cut)
        assert got.get((k, "test"), 0) == n - cut
    assert all(r["last_train"] is None or r["first_test"] is None or r["last_train"] < r["first_test"] for r in order)


def test_expanding_folds_closed_form(spark):
    lengths = list(range(3, 120))
    gap = 2
    f = rolling_folds(_many_series(spark, lengths), 2, gap, ["key"], CORRECTED)
    got = {(r["key"], r["fold"], r["role"]): (r["n"], r["lo"], r["hi"]) for r in f.groupBy("key", "fold", "role").agg(
        F.count("*").alias("n"), F.min("row_ix").alias("lo"), F.max("row_ix").alias("hi")).collect()}
    for k, n in enumerate(lengths):
        for fold in (1, 2):
            b, e = (fold * n) // 3, ((fold + 1) * n) // 3
            train = got.get((k, fold, "train"), (0, None, None))
            test = got.get((k, fold, "test"), (0, None, None))
            assert train[0] == max(0, b - gap)
            assert test[0] == e - b
            if train[0] and test[0]:
                assert train[2] + gap < test[1]


def test_fixed_folds_closed_form(spark):
    lengths = [n for n in range(11, 160) if n % 10]
    f = rolling_folds(_many_series(spark, lengths), 2, 0, ["key"], REFERENCE)
    got = {(r["key"], r["fold"], r["role"]): r["n"] for r in
           f.groupBy("key", "fold", "role").agg(F.count("*").alias("n")).collect()}
    for k, n in enumerate(lengths):
        initial = n % 10
        shift = (n - initial) // 2
        for fold in (1, 2):
            total = initial + shift * fold
            cut = math.ceil(total * float(np.float32(initial) / np.float32(total)))
            assert got.get((k, fold, "train"), 0) == cut
            assert got.get((k, fold, "test"), 0) == total - cut


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6)), min_size=1, max_size=20),
                min_size=1, max_size=8))
def test_smape_bounded_and_symmetric(spark, series):
    rows = [(k, D0 + dt.timedelta(weeks=i), p, a) for k, s in enumerate(series) for i, (p, a) in enumerate(s)]
    df = spark.createDataFrame(rows, "key int, date date, prediction double, label double")
    a = {r["key"]: r["smape"] for r in smape(df, 0, ["key"], CORRECTED, digits=None).collect()}
    swapped = df.select("key", "date", F.col("prediction").alias("label"), F.col("label").alias("prediction"))
    b = {r["key"]: r["smape"] for r in smape(swapped, 0, ["key"], CORRECTED, digits=None).collect()}
    for k, s in enumerate(series):
        terms = [abs(p - q) / ((abs(p) + abs(q)) / 2) if (abs(p) + abs(q)) else 0.0 for p, q in s]
        assert a[k] == pytest.approx(100 * sum(terms) / len(terms), rel=1e-9, abs=1e-9)
        assert a[k] == pytest.approx(b[k], rel=1e-11, abs=1e-12)
        assert 0 <= a[k] <= 200 + 1e-9


sales_rows = st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3), st.integers(0, 3), st.sampled_from(["a", "b"]),
                                st.integers(-10_000, 10_000)), min_size=1, max_size=40)
feature_rows = st.lists(st.tuples(st.integers(1, 3), st.integers(0, 3), st.sampled_from(["a", "b"]),
                                  st.one_of(st.none(), st.integers(0, 100))), max_size=30)


@settings(max_examples=6, deadline=None)
@given(sales_rows, feature_rows, st.sampled_from([(), ("store",)]))
def test_pre_aggregated_rollup_equals_row_level(spark, sales, feats, keys):
    """Duplicate covariate keys, null covariates and unmatched sales rows included."""
    from weekcast.operators.panel import merge_tables, weekly_panel

    s = spark.createDataFrame([(st_, dp, D0 + dt.timedelta(weeks=w), f, Decimal(c) / 100) for st_, dp, w, f, c in sales],
                              "store int, dept int, date date, flag string, weekly_sales decimal(18,2)")
    f = spark.createDataFrame([(st_, D0 + dt.timedelta(weeks=w), fl, None if t is None else t / 7.0)
                               for st_, w, fl, t in feats], "store int, date date, flag string, temp double")
    got = {tuple(r[k] for k in (*keys, "date")): r for r in
           weekly_panel(s, f, keys=keys, covariates=("temp",), holiday_values=("a",), normalize_flag=False,
                             validate=False).collect()}
    direct = merge_tables(s, f).groupBy(*keys, "date").agg(
        F.round(F.sum("weekly_sales")).cast("double").alias("total"), F.avg("temp").alias("temp"),
        F.avg(F.when(F.col("flag") == "a", 1).otherwise(0)).alias("hol")).collect()
    assert len(got) == len(direct)
    for r in direct:
        g = got[tuple(r[k] for k in (*keys, "date"))]
        assert g["total_sales"] == r["total"]
        assert g["is_holiday"] == pytest.approx(r["hol"], abs=1e-12)
        assert (g["temp"] is None and r["temp"] is None) or g["temp"] == pytest.approx(r["temp"], rel=1e-11)
