"""Scans, cleaning helpers, merge and weekly roll-up."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from weekcast.functions.columns import holiday_flag, parse_date, to_number
from weekcast.operators.panel import fill_weeks, merge_tables, undated_sales, weekly_panel
from weekcast.sources.fixtures import fixture_tables
from weekcast.sources.tables import retail_features, retail_sales, retail_stores, shape, single_row


def test_text_cleaning_never_raises_under_ansi(spark):
    df = spark.createDataFrame([("NA", "31/12/2011", "TRUE"), ("1.5", "bad", "True"), (None, "05/02/2010", "false")],
                               "x string, d string, f string")
    out = df.select(to_number("x").alias("x"), parse_date("d").alias("d"),
                    holiday_flag("f").alias("norm"), holiday_flag("f", ("TRUE",), False).alias("exact")).collect()
    assert [r["x"] for r in out] == [None, 1.5, None]
    assert [r["d"] for r in out] == [dt.date(2011, 12, 31), None, dt.date(2010, 2, 5)]
    assert [r["norm"] for r in out] == [1, 1, 0]
    # the original's exact comparison: text "True" is not a holiday
    assert [r["exact"] for r in out] == [1, 0, 0]


def test_boolean_flags(spark):
    df = spark.createDataFrame([(True,), (False,)], "f boolean")
    assert [r[0] for r in df.select(holiday_flag("f")).collect()] == [1, 0]


def test_single_row_fails_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "store int, v string")
    assert single_row(df, ["store", "v"]).count() == 5
    checked = single_row(df, ["store"], "covariates")       # no job runs here
    with pytest.raises(Exception, match="covariates: a key .store. is not unique: 1"):
        checked.collect()
    assert single_row(df.where("store = 2 or store is null"), ["store"]).columns == ["store", "v"]


def test_single_row_adds_no_aggregate_to_a_roll_up(spark):
    rolled = spark.createDataFrame([(1, 2.0), (2, 3.0), (2, 4.0)], "store int, v double").groupBy("store").agg(F.avg("v").alias("v"))
    count = lambda df, node: df._jdf.queryExecution().executedPlan().toString().count(node)
    checked = single_row(rolled, ["store"])
    assert all(count(checked, node) == count(rolled, node) > 0 for node in ("HashAggregate", "Exchange"))  # before it runs
    assert sorted(map(tuple, checked.collect())) == [(1, 2.0), (2, 3.5)]


def test_shapes_match_fixture_sizes(spark):
    t = fixture_tables(spark, SF_SMALL)
    rows = {r["table"]: (r["n_rows"], r["n_cols"]) for r in
            shape(t["sales"], "sales").unionByName(shape(t["stores"], "stores")).collect()}
    assert rows["stores"] == (10, 3)
    assert rows["sales"][1] == 5


def _retail(spark):
    sales = spark.createDataFrame([
        (1, 1, "05/02/2010", "24924.50", "FALSE"),
        (1, 2, "05/02/2010", "50605.27", "FALSE"),
        (2, 1, "05/02/2010", "100.00", "FALSE"),
        (1, 1, "12/02/2010", "46039.49", "TRUE"),
        (3, 1, "12/02/2010", "10.00", "TRUE"),      # no covariate row for store 3
        (1, 1, "31/02/2010", "1.00", "FALSE"),      # bad date
    ], "Store int, Dept int, Date string, Weekly_Sales string, IsHoliday string")
    feats = spark.createDataFrame([
        (1, "05/02/2010", 42.31, 2.572, "NA", "211.09", "8.106", "FALSE"),
        (2, "05/02/2010", 40.00, 2.600, "NA", "NA", "8.000", "FALSE"),
        (1, "12/02/2010", 38.51, 2.548, "NA", "211.24", "8.106", "TRUE"),
    ], "Store int, Date string, Temperature double, Fuel_Price double, MarkDown1 string, CPI string, "
       "Unemployment string, IsHoliday string")
    stores = spark.createDataFrame([(1, "A", 151315), (2, "B", 202307), (3, "A", 37392)], "Store int, Type string, Size int")
    return (retail_sales(sales), retail_features(feats, covariates=("Temperature", "Fuel_Price", "CPI", "Unemployment")),
            retail_stores(stores))


def test_retail_panel_matches_row_level_join(spark):
    sales, feats, stores = _retail(spark)
    covs = ("temperature", "fuel_price", "cpi", "unemployment")
    assert weekly_panel(sales, feats, stores, covariates=covs).count() == 2
    assert [r["weekly_sales"] for r in undated_sales(sales).collect()] == [1]
    panel = weekly_panel(sales, feats, stores, covariates=covs, undated="keep").orderBy("date").collect()
    assert [r["date"] for r in panel] == [None, dt.date(2010, 2, 5), dt.date(2010, 2, 12)]
    week1, week2 = panel[1], panel[2]
    assert week1["total_sales"] == round(24924.50 + 50605.27 + 100.00)
    # covariates are averaged over the joined sales rows (store 1 has two departments, S16)
    assert week1["temperature"] == pytest.approx((42.31 * 2 + 40.00) / 3)
    assert week1["cpi"] == pytest.approx(211.09)            # store 2's CPI is text NA -> null
    assert week2["temperature"] == pytest.approx(38.51)     # store 3 has no covariates: left join
    assert week2["is_holiday"] == 1.0 and week1["is_holiday"] == 0.0
    # same numbers as the plain row-level plan
    merged = merge_tables(sales, feats, stores).where(F.col("date").isNotNull())
    direct = {r["date"]: r for r in merged.groupBy("date").agg(
        F.round(F.sum("weekly_sales")).alias("t"), F.avg("temperature").alias("temp")).collect()}
    for r in (week1, week2):
        assert r["total_sales"] == direct[r["date"]]["t"]
        assert r["temperature"] == pytest.approx(direct[r["date"]]["temp"])


def test_duplicate_right_keys_multiply_like_the_row_level_join(spark):
    sales = spark.createDataFrame([(1, 1, dt.date(2010, 2, 5), "false", 10.0), (1, 2, dt.date(2010, 2, 5), "false", 20.0)],
                                  "store int, dept int, date date, flag string, weekly_sales double")
    feats = spark.createDataFrame([(1, dt.date(2010, 2, 5), "false", 1.0), (1, dt.date(2010, 2, 5), "false", 3.0)],
                                  "store int, date date, flag string, temp double")
    p = weekly_panel(sales, feats, covariates=("temp",), validate=False).first()
    m = merge_tables(sales, feats).agg(F.sum("weekly_sales").alias("s"), F.avg("temp").alias("t")).first()
    assert p["total_sales"] == m["s"] == 60.0
    assert p["temp"] == pytest.approx(m["t"])


def test_keyed_panel_is_union_of_single_series(spark):
    t = fixture_tables(spark, SF_SMALL)
    kw = dict(covariates=("temp", "cpi"), holiday_values=("R",), normalize_flag=False)
    keyed = weekly_panel(t["sales"], t["features"], t["stores"], keys=["nation"], **kw)
    nation = keyed.select("nation").where(F.col("nation").isNotNull()).first()["nation"]
    sub_sales = t["sales"].join(t["stores"].where(F.col("nation") == nation).select("store"), ["store"])
    single = weekly_panel(sub_sales, t["features"], **kw)
    a = sorted((r["date"], r["total_sales"], round(r["temp"] or 0, 9)) for r in
               keyed.where(F.col("nation") == nation).collect())
    b = sorted((r["date"], r["total_sales"], round(r["temp"] or 0, 9)) for r in single.collect())
    assert a == b


def test_catalog_tables_scan(spark):
    from weekcast.sources.tables import catalog_tables

    t = fixture_tables(spark, SF_SMALL)
    for name, df in t.items():
        df.createOrReplaceTempView(name)
    cat = catalog_tables(spark)
    assert cat["sales"].count() == t["sales"].count()
    assert set(cat) == {"sales", "features", "stores"}


def test_half_cent_week_rounds_half_up_and_missing_week_slides(spark):
    """A week summing to x.50 rounds up (exact decimal sum); a missing week is simply absent, so
    row lags slide over it (the default row semantics)."""
    from decimal import Decimal

    from weekcast.config import CORRECTED
    from weekcast.operators.features import build_features

    d0 = dt.date(2010, 1, 4)
    rows = []
    for i in range(60):
        if i == 55:
            continue                                  # missing week
        rows.append((1, 1, d0 + dt.timedelta(weeks=i), "false", Decimal("1000.25") + i))
        rows.append((1, 2, d0 + dt.timedelta(weeks=i), "false", Decimal("0.25")))
    sales = spark.createDataFrame(rows, "store int, dept int, date date, flag string, weekly_sales decimal(18,2)")
    p = weekly_panel(sales, covariates=())
    got = {r["date"]: r["total_sales"] for r in p.collect()}
    assert got[d0] == 1001.0                          # 1000.50 -> 1001 (half up)
    assert d0 + dt.timedelta(weeks=55) not in got
    f = build_features(p, 1, (), CORRECTED).orderBy("date").collect()
    after_gap = [r for r in f if r["date"] == d0 + dt.timedelta(weeks=56)][0]
    assert after_gap["lag_1week"] == got[d0 + dt.timedelta(weeks=54)] - got[d0 + dt.timedelta(weeks=54 - 48)]


def test_validate_rejects_duplicate_covariate_keys(spark):
    sales = spark.createDataFrame([(1, 1, dt.date(2010, 2, 5), "false", 10.0)],
                                  "store int, dept int, date date, flag string, weekly_sales double")
    feats = spark.createDataFrame([(1, dt.date(2010, 2, 5), "false", 1.0), (1, dt.date(2010, 2, 5), "false", 3.0)],
                                  "store int, date date, flag string, temp double")
    with pytest.raises(Exception, match="covariates"):
        weekly_panel(sales, feats, covariates=("temp",)).collect()
    assert weekly_panel(sales, feats.limit(1), covariates=("temp",)).count() == 1


def _one_week(spark, values, sales=None):
    """Stores 1..n with one sales row and one covariate value each."""
    day = dt.date(2010, 2, 5)
    sales = sales or [1.0] * len(values)
    s = spark.createDataFrame([(i, 1, day, "false", x) for i, x in enumerate(sales)],
                              "store int, dept int, date date, flag string, weekly_sales double")
    f = spark.createDataFrame([(i, day, "false", v) for i, v in enumerate(values)], "store int, date date, flag string, temp double")
    return weekly_panel(s, f, covariates=("temp",)).first()


@pytest.mark.parametrize("values,mean", [([2e20, 1.0], 1e20), ([6e19, 6e19], 6e19), ([1e-19, 1e-19], 1e-19),
                                         ([1e-310, 1e-310], 1e-310), ([1e305, 1e305], 1e305), ([0.0, 0.0], 0.0), ([None, 3.0], 3.0)])
def test_covariate_means_of_any_size(spark, values, mean):
    assert _one_week(spark, values)["temp"] == pytest.approx(mean, rel=1e-11, abs=0)


def test_amounts_keep_sub_cent_digits_and_never_vanish(spark):
    def sales(*values):
        rows = [(1, i, "05/02/2010", v, "FALSE") for i, v in enumerate(values)]
        return retail_sales(spark.createDataFrame(rows, "Store int, Dept int, Date string, Weekly_Sales string, IsHoliday string"))

    assert weekly_panel(sales(*["0.004"] * 500)).first()["total_sales"] == 2.0
    assert sum(r["weekly_sales"] for r in sales("99000000000000000", "1").collect()) == 99000000000000001
    assert weekly_panel(sales("99000000000000000", "1")).first()["total_sales"] == 9.9e16
    assert [r["weekly_sales"] for r in sales("NA", " ", None, "na").collect()] == [None] * 4
    for bad in ("1" * 30, "much"):
        with pytest.raises(Exception):
            sales(bad).collect()


def test_undated_sales_stay_out_of_every_series(spark):
    from weekcast.config import CORRECTED
    from weekcast.operators.features import build_features

    d0 = dt.date(2010, 1, 4)
    rows = [(1, 1, d0 + dt.timedelta(weeks=i), "false", 1000.0 + i) for i in range(70)] + [(1, 1, None, "false", 5000.0)]
    sales = spark.createDataFrame(rows, "store int, dept int, date date, flag string, weekly_sales double")
    first = build_features(weekly_panel(sales), 1, (), CORRECTED).orderBy("date").first()
    clean = build_features(weekly_panel(sales.where("date is not null")), 1, (), CORRECTED).orderBy("date").first()
    assert first == clean
    with pytest.raises(Exception, match="no date"):
        weekly_panel(sales, undated="raise").collect()
    with pytest.raises(ValueError):
        weekly_panel(sales, undated="ignore")


def test_fill_weeks_inserts_and_never_deletes(spark):
    d = lambda day: dt.date(2010, 1, day)
    rows = [("a", d(3), 1.0), ("a", d(11), 2.0), ("a", d(17), 3.0), ("a", dt.date(2010, 2, 7), 4.0),
            (None, d(3), 5.0), (None, d(24), 6.0), ("b", None, 7.0), ("b", d(10), 8.0)]
    panel = spark.createDataFrame(rows, "k string, date date, total_sales double")
    got = {(r["k"], r["date"], r["total_sales"]) for r in fill_weeks(panel, ["k"]).collect()}
    assert got == set(rows) | {("a", d(24), None), ("a", d(31), None), (None, d(10), None), (None, d(17), None)}
    kept = fill_weeks(panel.where("k = 'a'").drop("k")).count()
    assert kept == 6


def test_null_series_keys_meet_their_own_rows(spark):
    from weekcast.operators.evaluate import left_by_key, retrend_by_join

    day = dt.date(2010, 1, 4)
    pred = spark.createDataFrame([(None, day, 1.0, 2.0), ("a", day, 3.0, 4.0)], "k string, date date, prediction double, label double")
    levels = spark.createDataFrame([(None, day, 10.0), ("a", day, 20.0)], "k string, date date, level double")
    got = {r["k"]: (r["prediction"], r["label"], r["level"]) for r in retrend_by_join(pred, levels, ["k"]).collect()}
    assert got == {None: (11.0, 12.0, 10.0), "a": (23.0, 24.0, 20.0)}
    assert left_by_key(pred, levels, ["k", "date"]).columns == ["k", "date", "prediction", "label", "level"]


@pytest.mark.parametrize("rows_per_task", [1, 40, 10**9])
def test_spread_merge_equals_the_plain_one(spark, rows_per_task):
    from weekcast.operators.panel import merge_tables

    sales = spark.createDataFrame([(1 if i % 3 else None if i % 2 else i, "R" if i % 5 else None, float(i)) for i in range(300)], "store long, flag string, weekly_sales double").withColumn("date", F.lit(dt.date(2020, 1, 6)))
    feats = sales.where("store is not null").groupBy("store", "date", "flag").agg(F.avg("weekly_sales").alias("temp"))
    stores = spark.createDataFrame([(1, "a"), (6, "b"), (6, "c"), (None, "d")], "store long, type string")
    plain, spread = merge_tables(sales, feats, stores), merge_tables(sales, feats, stores, rows_per_task=rows_per_task)
    assert plain.columns == spread.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, spread.collect()))


def test_a_key_with_a_third_of_the_rows_is_split_over_tasks(spark):
    """Without AQE, no task of the spread join gets much more than its share; the plain join puts the hot key in one."""
    from weekcast.operators.panel import merge_tables

    sales = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("store"), F.lit(dt.date(2020, 1, 6)).alias("date"), F.lit("R").alias("flag"), F.lit(1.0).alias("weekly_sales"))
    feats = sales.select("store", "date", "flag").distinct().withColumn("temp", F.lit(2.0))
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(held, ("false", "-1", "16")):
            spark.conf.set(k, v)

        def most(df):
            sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]
            assert sum(sizes) == 30000
            return max(sizes)

        assert most(merge_tables(sales, feats)) > 10000
        assert most(merge_tables(sales, feats, rows_per_task=500)) < 30000 / 16 * 2
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
