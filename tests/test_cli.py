"""The command-line flow on catalog tables in the original retail layout (derived from the driver tables)."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from weekcast.__main__ import main
from weekcast.sources.fixtures import fixture_tables


def test_catalog_flow(spark, capsys, tmp_path):
    t = fixture_tables(spark, SF_SMALL)
    holiday = F.when(F.col("flag") == "R", F.lit("TRUE")).otherwise(F.lit("FALSE"))
    text_date = F.date_format("date", "dd/MM/yyyy")
    t["sales"].select(F.col("store").alias("Store"), F.col("dept").alias("Dept"), text_date.alias("Date"),
                      F.col("weekly_sales").cast("string").alias("Weekly_Sales"),
                      holiday.alias("IsHoliday")).createOrReplaceTempView("sales")
    feats = t["features"].withColumn("IsHoliday", holiday).groupBy("store", "date", "IsHoliday").agg(
        F.avg("temp").alias("Temperature"), F.avg("cpi").alias("CPI"))
    feats.select(F.col("store").alias("Store"), text_date.alias("Date"), "Temperature",
                 F.lit(3.1).alias("Fuel_Price"), *[F.lit("NA").alias(f"MarkDown{i}") for i in range(1, 6)],
                 F.col("CPI").cast("string").alias("CPI"), F.lit("8.1").alias("Unemployment"),
                 "IsHoliday").createOrReplaceTempView("features")
    t["stores"].select(F.col("store").alias("Store"), F.lit("A").alias("Type"),
                       F.lit(100000).alias("Size")).createOrReplaceTempView("stores")
    main(["--source", "catalog", "--horizons", "2", "--models", "lr", "--preset", "reference"])
    out = capsys.readouterr().out
    assert "SMA" in out and "Linear Regression" in out and "2 weeks" in out and "2 rows" in out and "left out: 0" in out
    main(["--source", "catalog", "--horizons", "2", "--models", "lr", "--keys", "store", "--fill", "--out", str(tmp_path / "table")])
    out = capsys.readouterr().out
    written = spark.read.parquet(str(tmp_path / "table"))
    assert f"{written.count()} rows, all of them in" in out
    assert written.count() == 2 * t["stores"].count()
