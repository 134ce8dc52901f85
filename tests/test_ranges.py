"""One long series in parallel: positions, splits, windows by ranges, lags by period, date ranges pushed to the scan."""

import contextlib
import datetime as dt
import io
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, weekly_dates
from weekcast.config import CORRECTED, REFERENCE
from weekcast.operators.between import features_between, reach, widened
from weekcast.operators.evaluate import sma_forecast
from weekcast.operators.features import build_features, lag_name
from weekcast.operators.panel import fill_weeks
from weekcast.operators.period_lags import features_by_period, period_lags
from weekcast.operators.ranges import build_features_by_ranges, over_ranges, positions, sma_by_ranges, split_by_ranges, ts_split_by_ranges
from weekcast.operators.split import split_frame, ts_split
from weekcast.queries import BETWEEN, panel, tables


def plan_of(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture
def series(make_series):
    rng = random.Random(4)
    return lambda n: make_series([rng.uniform(1e6, 2e6) for _ in range(n)]).withColumns({"month": F.month("date"), "day": F.dayofmonth("date")})


@pytest.mark.parametrize("h", [1, 3])
@pytest.mark.parametrize("rows", [7, 64, 1000])
def test_features_by_ranges_equal_the_one_task_plan(series, h, rows):
    s = series(180)
    assert rows_of(build_features_by_ranges(s, h, CORRECTED, rows=rows)) == rows_of(build_features(s, h, (), CORRECTED))


def test_features_by_ranges_with_nulls_and_short_series(series):
    s = series(150).withColumn("total_sales", F.when(F.dayofmonth("date") % 9 != 0, F.col("total_sales")))
    assert rows_of(build_features_by_ranges(s, 2, CORRECTED, rows=20)) == rows_of(build_features(s, 2, (), CORRECTED))
    assert build_features_by_ranges(series(30), 1, CORRECTED, rows=10).collect() == []
    assert build_features_by_ranges(series(30).limit(0), 1, CORRECTED).collect() == []


def test_no_single_partition(series, spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "SinglePartition" in plan_of(build_features(series(180), 1, (), CORRECTED))
        for df in (build_features_by_ranges(series(180), 1, CORRECTED, rows=32), sma_by_ranges(series(180), 3, rows=32), split_by_ranges(series(180))):
            assert "SinglePartition" not in plan_of(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_presets_that_need_the_whole_series_are_refused(series):
    with pytest.raises(ValueError, match="warmup"):
        build_features_by_ranges(series(10), 1, REFERENCE)
    with pytest.raises(ValueError, match="sma_order"):
        sma_by_ranges(series(10), 2, REFERENCE)
    with pytest.raises(ValueError, match="positive"):
        over_ranges(series(10), 1, 1, lambda part, keys: part, rows=0)


def test_moving_average_by_ranges(series):
    s = series(100)
    assert rows_of(sma_by_ranges(s, 4, rows=9)) == rows_of(sma_forecast(s, 4, (), CORRECTED))


def test_positions_of_raw_rows_with_a_hot_date(spark):
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.05 else dt.date(2020, 1, 1) if rng.random() < 0.4 else dt.date(2020, 1, 1 + rng.randrange(28)), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "date date, id long").repartition(7)
    got = [(r.date, r.id) for r in positions(df, ("date", "id")).orderBy("row_ix").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or dt.date.min, r[1]))
    placed = positions(df, ("date", "id")).agg(F.min("row_ix"), F.max("row_ix"), F.count_distinct("row_ix"), F.max("n_rows")).first()
    assert tuple(placed) == (1, 4000, 4000, 4000)


@pytest.mark.parametrize(("n", "gap"), [(101, 0), (143, 7), (1, 0)])
def test_split_by_ranges_equals_the_window(series, n, gap):
    s = series(n)
    assert rows_of(split_by_ranges(s, 0.8, gap)) == rows_of(split_frame(s, 0.8, gap))
    assert [rows_of(p) for p in ts_split_by_ranges(s)] == [rows_of(p) for p in ts_split(s)]


# -- lags by period -------------------------------------------------------------------------------------


def test_period_lags_equal_row_lags_without_gaps(series):
    s = series(120)
    by_row = build_features(s, 1, (), CORRECTED)
    names = ["date", "diff_sales", "lag_1year", "label", *[lag_name(k) for k in range(1, 5)]]
    rows = by_row.select("date", "diff_sales", "label", *[lag_name(k) for k in range(1, 5)])
    by_period = features_by_period(s, 1, (), CORRECTED).select(*[n for n in names if n != "lag_1year"])
    assert rows_of(by_period.join(rows.select("date"), "date")) == rows_of(rows)


def test_period_lags_over_gaps_equal_lags_of_the_filled_series(spark, series):
    s = series(90).where(F.dayofmonth("date") % 5 != 0).withColumn("key", F.when(F.month("date") > 3, "a"))
    filled = fill_weeks(s, ("key",))
    want = {}
    for r in filled.collect():
        want[r.key, r.date] = r.total_sales
    for r in period_lags(s, {"back": ("total_sales", 3), "ahead": ("total_sales", -2)}, ("key",)).collect():
        assert r.back == want.get((r.key, r.date - dt.timedelta(weeks=3))) and r.ahead == want.get((r.key, r.date + dt.timedelta(weeks=2)))


def test_period_lags_edges(spark):
    df = spark.createDataFrame([("a", None, 1.0), (None, dt.date(2020, 1, 6), 2.0), (None, dt.date(2020, 1, 13), 3.0)], "key string, date date, total_sales double")
    got = {(r.key, r.date): r.x for r in period_lags(df, {"x": ("total_sales", 1)}, ("key",)).collect()}
    assert got == {("a", None): None, (None, dt.date(2020, 1, 6)): None, (None, dt.date(2020, 1, 13)): 2.0}
    with pytest.raises(Exception, match="two rows of one series"):
        period_lags(spark.createDataFrame([(dt.date(2020, 1, 6), 1.0), (dt.date(2020, 1, 8), 1.0)], "date date, total_sales double"), {"x": ("total_sales", 1)}).collect()


def test_a_hot_series_is_spread(spark):
    """Every exchange of the lags is hashed by the period too."""
    df = spark.createDataFrame([("a", d, 1.0) for d in weekly_dates(60)], "key string, date date, total_sales double")
    text = plan_of(period_lags(df, {"x": ("total_sales", 1)}, ("key",)), "simple")
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("_index" in line for line in exchanges) and "Window" not in text


# -- a date range pushed through the windows -----------------------------------------------------------------


@pytest.mark.parametrize("keys", [(), ("key",)])
def test_features_between_equals_filtering(spark, keys):
    rng = random.Random(9)
    start = dt.date(2010, 2, 5)
    rows = [(k, start + dt.timedelta(weeks=w), rng.uniform(1, 9)) for k, first, share in (("a", 0, 1.0), ("b", 40, 0.7), ("c", 120, 1.0), (None, 90, 0.9))
            for w in range(first, 220) if rng.random() < share]
    if not keys:
        rows = [r for r in rows if r[0] == "b"]
    whole = spark.createDataFrame(rows, "key string, date date, total_sales double").select(*keys, "date", "total_sales")
    asked = []

    def panel_of(lo, hi):
        asked.append((lo, hi))
        return whole.where(F.col("date").between(F.lit(lo), F.lit(hi)))

    for a, b in ((130, 150), (0, 30), (200, 400), (60, 60)):
        between = (start + dt.timedelta(weeks=a), start + dt.timedelta(weeks=b))
        got = features_between(whole.select(*keys, "date"), panel_of, between, 2, keys, CORRECTED)
        assert rows_of(got) == rows_of(build_features(whole, 2, keys, CORRECTED).where(F.col("date").between(*map(F.lit, between))))
    assert all(lo <= hi for lo, hi in asked) and asked[0][0] > start or keys


def test_widened_counts_rows_not_weeks(spark):
    dates = [dt.date(2020, 1, 6) + dt.timedelta(weeks=w) for w in (0, 1, 2, 10, 11, 12, 13)]
    cal = spark.createDataFrame([(d,) for d in dates], "date date")
    assert widened(cal, (dates[4], dates[4]), 2, 1) == (dates[2], dates[5])
    assert widened(cal, (dates[4], dates[4]), 99, 99) == (dates[0], dates[-1])
    assert widened(cal.limit(0), (dates[1], dates[2]), 3, 3) == (dates[1], dates[2])


def test_the_range_reaches_the_scan(spark):
    calendar = tables(spark, SF_SMALL, ("sales",))["sales"].select("date").distinct()
    asked = []

    def panel_of(lo, hi):
        asked.append((lo, hi))
        return panel(spark, SF_SMALL, (), (lo, hi))

    text = plan_of(features_between(calendar, panel_of, BETWEEN, 1))
    pushed = [line for line in text.splitlines() if line.startswith("PushedFilters")]
    assert pushed and all("GreaterThanOrEqual(l_shipdate" in line and "LessThan(l_shipdate" in line for line in pushed)
    before, after = reach(1)
    assert asked == [(BETWEEN[0] - dt.timedelta(weeks=before), BETWEEN[1] + dt.timedelta(weeks=after))]
