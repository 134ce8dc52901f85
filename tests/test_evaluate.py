"""Scores, retrend and the moving-average baseline (C3, D5, D6, E8, I16-I18, I23; S8, S9, S14)."""

import datetime as dt

import pytest

from weekcast.config import CORRECTED, REFERENCE
from weekcast.operators.evaluate import retrend, retrend_by_join, rmse, sma_forecast, sma_test_frame, smape


def _pred(spark, rows):
    d0 = dt.date(2011, 1, 7)
    return spark.createDataFrame([(d0 + dt.timedelta(weeks=i), float(p) if p is not None else None,
                                   float(a) if a is not None else None, 100.0) for i, (p, a) in enumerate(rows)],
                                 "date date, prediction double, label double, level double")


def test_smape_value_bounds_and_symmetry(spark):
    rows = [(110, 100), (90, 100), (0, 50), (100, 100)]
    s = smape(_pred(spark, rows), digits=None).first()["smape"]
    expected = 100 / 4 * (10 / 105 + 10 / 95 + 50 / 25 + 0)
    assert s == pytest.approx(expected)
    swapped = smape(_pred(spark, [(a, p) for p, a in rows]), digits=None).first()["smape"]
    assert swapped == pytest.approx(s)
    assert 0 <= s <= 200


def test_smape_trim_and_denominator(spark):
    """The original trims the last rows but still divides by every row."""
    rows = [(110, 100), (90, 100), (120, 100), (1, 0)]
    df = _pred(spark, rows)
    all_ = smape(df, trim_last=1, preset=REFERENCE, digits=None).first()
    scored = smape(df, trim_last=1, preset=CORRECTED, digits=None).first()
    assert all_["n_scored"] == scored["n_scored"] == 3
    assert all_["smape"] == pytest.approx(scored["smape"] * 3 / 4)


def test_smape_skips_missing_actuals(spark):
    df = _pred(spark, [(110, 100), (50, None)])
    assert smape(df, preset=CORRECTED, digits=None).first()["smape"] == pytest.approx(100 * 10 / 105)


def test_rmse(spark):
    r = rmse(_pred(spark, [(3, 0), (0, 4), (5, None)])).first()
    assert r["rmse"] == pytest.approx(((9 + 16) / 2) ** 0.5) and r["n"] == 2


def test_retrend_and_join_agree(spark):
    df = _pred(spark, [(1, 2), (3, 4)])
    a = sorted(tuple(r) for r in retrend(df).select("date", "prediction", "label").collect())
    levels = df.select("date", "level")
    b = sorted(tuple(r) for r in retrend_by_join(df.drop("level"), levels.repartition(3)).select(
        "date", "prediction", "label").collect())
    assert a == b and a[0][1:] == (101.0, 102.0)


def test_sma_order_and_history(make_series):
    df = make_series([10, 20, 30, 40, 50, 60, 70, 80, 90, 100])
    out = {r["date"]: r["sma"] for r in sma_forecast(df, 2).collect()}
    vals = sorted(out.items())
    assert vals[0][1] is None and vals[1][1] == 10 and vals[2][1] == 15
    ref = sma_test_frame(df, 2, 0.8, (), REFERENCE).orderBy("date").collect()
    cor = sma_test_frame(df, 2, 0.8, (), CORRECTED).orderBy("date").collect()
    # the original's window sees only test rows: the first test row has no forecast
    assert ref[0]["prediction"] is None and cor[0]["prediction"] == 75.0


def test_sma_day_order(make_series):
    """Ordering by day of month mixes months (S9); the date breaks ties."""
    df = make_series([1, 2, 3, 4, 5, 6, 7, 8], start=dt.date(2011, 1, 28))
    rows = sma_forecast(df, 1, (), REFERENCE).collect()
    by_date = {r["date"]: r["sma"] for r in rows}
    # 2011-02-04 (day 4) is ordered before 2011-01-28 (day 28), so it has no previous row
    assert by_date[dt.date(2011, 2, 4)] is None
