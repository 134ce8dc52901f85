"""Mapping of the driver's TPC-H-like tables onto the retail roles (FIXTURES.md §4).

sales    = lineitem, one row each: (supplier, part, return flag, week, price)
features = lineitem rolled up to (supplier, return flag, week): temp = avg(discount), cpi = avg(tax)
stores   = supplier: store, nation, acctbal
holiday  = return flag 'R'

The features roll-up runs a partial aggregate before its shuffle and is hash-partitioned on exactly the
sales -> features join key, so that side of the join needs no second exchange.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.sources.tables import MONEY

# Fixed values of the mapping.
HOLIDAY_FLAGS = ("R",)
COVARIATES = ("temp", "cpi")

# Columns of the driver's tables that the mapping reads (FIXTURES.md §4). Declaring them skips schema
# inference and lets the scan read only these columns.
LINEITEM_SCHEMA = T.StructType([
    T.StructField("l_partkey", T.LongType()),
    T.StructField("l_suppkey", T.LongType()),
    T.StructField("l_extendedprice", T.DoubleType()),
    T.StructField("l_discount", T.DoubleType()),
    T.StructField("l_tax", T.DoubleType()),
    T.StructField("l_returnflag", T.StringType()),
    T.StructField("l_shipdate", T.TimestampNTZType()),
])
SUPPLIER_SCHEMA = T.StructType([
    T.StructField("s_suppkey", T.LongType()),
    T.StructField("s_nationkey", T.IntegerType()),
    T.StructField("s_acctbal", T.DoubleType()),
])


def week_start(c: str | F.Column) -> F.Column:
    """Monday of the week, as a DATE."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trunc(F.to_date(c), "week")


def sales_from_lineitem(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_suppkey").alias("store"),
        F.col("l_partkey").alias("dept"),
        F.col("l_returnflag").alias("flag"),
        week_start("l_shipdate").alias("date"),
        F.col("l_extendedprice").cast(MONEY).alias("weekly_sales"),
    )


def features_from_lineitem(lineitem: DataFrame) -> DataFrame:
    return (
        lineitem.select(
            F.col("l_suppkey").alias("store"),
            F.col("l_returnflag").alias("flag"),
            week_start("l_shipdate").alias("date"),
            F.col("l_discount"),
            F.col("l_tax"),
        )
        .groupBy("store", "date", "flag")
        .agg(*[F.avg(src).alias(out) for out, src in (("temp", "l_discount"), ("cpi", "l_tax"))])
    )


def stores_from_supplier(supplier: DataFrame) -> DataFrame:
    return supplier.select(
        F.col("s_suppkey").alias("store"),
        F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("acctbal"),
    )


ROLES = ("sales", "features", "stores")


def shipped_between(lineitem: DataFrame, first_week: dt.date, last_week: dt.date) -> DataFrame:
    """Rows of the weeks from ``first_week`` to ``last_week`` (Mondays), as a range of the stored column, which
    the scan can skip by."""
    at = lambda d: F.expr(f"TIMESTAMP_NTZ '{d.isoformat()} 00:00:00'")
    return lineitem.where((F.col("l_shipdate") >= at(first_week)) & (F.col("l_shipdate") < at(last_week + dt.timedelta(days=7))))


def fixture_tables(spark: SparkSession, sf_dir: str, roles=ROLES, weeks: tuple[dt.date, dt.date] | None = None) -> dict[str, DataFrame]:
    """The requested roles (default all three) as lazy plans over the parquet files in ``sf_dir``; a
    query that needs no dimension asks for no ``stores`` and never scans the supplier table. ``weeks`` limits
    the facts to a range of weeks."""
    base = sf_dir.rstrip("/")
    out: dict[str, DataFrame] = {}
    if "sales" in roles or "features" in roles:
        lineitem = spark.read.schema(LINEITEM_SCHEMA).parquet(f"{base}/lineitem.parquet")
        lineitem = shipped_between(lineitem, *weeks) if weeks else lineitem
        if "sales" in roles:
            out["sales"] = sales_from_lineitem(lineitem)
        if "features" in roles:
            out["features"] = features_from_lineitem(lineitem)
    if "stores" in roles:
        out["stores"] = stores_from_supplier(spark.read.schema(SUPPLIER_SCHEMA).parquet(f"{base}/supplier.parquet"))
    return out
