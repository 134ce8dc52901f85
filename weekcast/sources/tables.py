"""Scans, previews, shapes and key checks (inventory A1-A3, S17-S19).

Canonical column names used by every operator:

* sales:    ``store, dept, date, flag, weekly_sales`` (grain store x dept x date)
* features: ``store, date, flag`` + covariate columns (grain store x date x flag)
* stores:   ``store`` + dimension columns (grain store)

``flag`` is the holiday marker; it is a join key between sales and features, as in the original.
"""

from __future__ import annotations

from weekcast.constants import DATE_FORMAT, MISSING, RETAIL_COVARIATES

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.functions.columns import parse_date, to_number

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def catalog_tables(spark: SparkSession, names: Sequence[str] = ("sales", "features", "stores")) -> dict[str, DataFrame]:
    """Catalog scans, for tables registered under the original names."""
    return {n: spark.table(n) for n in names}


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """First ``n`` rows in a stated order (``show(10)`` without a sort has no defined rows).
    Spark plans this as TakeOrderedAndProject: a per-partition top-n, never a full sort."""
    return df.orderBy(*order_by).limit(n)


def shape(df: DataFrame, name: str) -> DataFrame:
    """``(table, n_rows, n_cols)`` as a one-row frame; the count is a metadata-only scan for parquet."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table"), F.col("n_rows"), F.lit(len(df.columns)).cast(T.IntegerType()).alias("n_cols")
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; a partial + final aggregate, no collect."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """Fail if the right side of a left join would multiply rows (S18). One job; only one row
    comes back to the driver."""
    dup = duplicate_keys(df, keys).limit(1).collect()
    if dup:
        raise ValueError(f"{what}: key {list(keys)} is not unique, e.g. {dup[0].asDict()}")
    return df


def single_row(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """``df`` with one row per key, failing the job that reads it when a key has more (S18). Part of the
    plan, not a job of its own; rows with a null in the key match nothing in a join and pass."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    message = F.concat(F.lit(f"{what}: a key ({', '.join(keys)}) is not unique: "),
                       F.concat_ws(", ", *[F.col(k).cast(T.StringType()) for k in keys]))
    # counted over the rows in key order: the sort that a merge join on the keys needs anyway, and no second aggregate
    counted = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    checked = F.when((F.col("_n") > 1) & known, F.raise_error(message)).otherwise(F.lit(0))
    # the check is a filter, which no optimizer rule drops
    return counted.where(checked.cast(T.IntegerType()) == 0).select(*df.columns)


# -- tables in the original retail layout ------------------------------------------------------------

def _flag_text(c: str) -> F.Column:
    return F.lower(F.trim(F.col(c).cast(T.StringType())))


#: sales amounts: sub-cent digits are kept, so that a week is summed first and rounded once
MONEY = T.DecimalType(28, 6)


def money(c: str) -> F.Column:
    """An amount as an exact decimal. Blank text and the text for a missing number are null; anything else
    that is no number, or does not fit, fails the job: no sale vanishes from a total."""
    text = F.upper(F.trim(F.col(c).cast(T.StringType())))
    return F.when(text.isin("", MISSING), None).otherwise(F.col(c)).cast(MONEY)


def retail_sales(df: DataFrame, date_format: str = DATE_FORMAT) -> DataFrame:
    """``Store, Dept, Date, Weekly_Sales, IsHoliday`` -> canonical sales. The date is parsed before any
    join (S17), the flag normalised so boolean and text spellings join alike (S15), and money is a
    decimal so that weekly sums are exact and their rounding cannot depend on summation order (S24)."""
    return df.select(
        F.col("Store").alias("store"),
        F.col("Dept").alias("dept"),
        parse_date("Date", date_format).alias("date"),
        _flag_text("IsHoliday").alias("flag"),
        money("Weekly_Sales").alias("weekly_sales"),
    )


def retail_features(df: DataFrame, date_format: str = DATE_FORMAT,
                    covariates: Sequence[str] = RETAIL_COVARIATES) -> DataFrame:
    """Covariate table; text ``NA`` becomes null through ``try_cast``."""
    return df.select(
        F.col("Store").alias("store"),
        parse_date("Date", date_format).alias("date"),
        _flag_text("IsHoliday").alias("flag"),
        *[to_number(c).alias(c.lower()) for c in covariates],
    )


def retail_stores(df: DataFrame) -> DataFrame:
    return df.select(F.col("Store").alias("store"), *[F.col(c).alias(c.lower()) for c in df.columns if c != "Store"])

