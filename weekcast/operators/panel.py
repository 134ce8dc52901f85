"""Merge and weekly roll-up (inventory C1, C2, D1-D4, B9, H2-H4, I1, I2).

Plan shape of ``weekly_panel`` for a 100 TB fact table:

1. sales are pre-aggregated to the join grain (store, date, flag [, sales-side series keys]) with a
   partial aggregate before the shuffle, keeping a row count so that covariate means stay weighted
   by sales rows exactly as the original row-level join + ``avg`` weights them (S16). This is the only
   exchange of fact rows unless a series key lies outside the join keys (``keys=("dept",)``): then the
   pre-aggregate is nearly fact-sized and is exchanged once more for the join.
2. left join with the covariates on the same three keys: both sides arrive hash-partitioned on them
   (the pre-aggregate's exchange, and the covariate roll-up's), so the sort-merge join adds no shuffle.
3. the dimension joins only when a dimension column is asked for; Spark's byte-based threshold and AQE
   choose between broadcast and sort-merge, with skew splitting.
4. final roll-up to (series keys, date): partial + final aggregate; the output has one row per series
   and week, so the window steps that follow never see raw rows. When every series is one store (or
   finer), a store's pre-aggregated rows are bounded by weeks x flags, so the roll-up is fed by one
   exchange on the series keys, which the per-series windows downstream reuse (one shuffle, not two).
   Coarser keys (e.g. nation) keep the partial aggregate before their exchange instead.

``merge_tables`` keeps raw rows by definition: its exchange carries them whole. With ``rows_per_task`` the rows of
a heavy key are split by a salt against copies of the key's right-side row; without, AQE splits a hot key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.functions.columns import holiday_flag
from weekcast.operators.evaluate import left_by_key
from weekcast.session import materialize
from weekcast.sources.tables import single_row

JOIN_KEYS = ("store", "date", "flag")
DIM_KEY = "store"
#: significant digits of a covariate mean: the noise of the order in which partial sums meet is far below
SIGNIFICANT = 12
#: at most so many keys count as heavy
HEAVY_KEYS = 10_000


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], rows_per_task: int, heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """Left join on ``on`` in which no key brings more than about ``rows_per_task`` left rows to one task.

    A count finds the heavy keys, those with more rows than ``rows_per_task`` and than a ``heavy_keys``-th of all
    rows; there are fewer than ``heavy_keys`` of them, so they may be told to all tasks. Their left rows get a
    salt each, and their right rows are copied once for each salt. Left rows with a null in the key match nothing,
    but are salted alike."""
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(counts)
    total = counts.agg(F.sum("_n")).first()[0] or 0
    limit = max(int(rows_per_task), -(-total // heavy_keys))
    heavy = F.broadcast(counts.where(F.col("_n") > limit).select(*on, F.ceil(F.col("_n") / limit).cast(T.IntegerType()).alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    salted = left_by_key(left, heavy, on).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), salts).cast(T.IntegerType())).drop("_salts")
    copies = left_by_key(right, heavy, on).withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted.join(copies, [*on, "_salt"], "left").drop("_salt")


def merge_tables(
    sales: DataFrame,
    features: DataFrame | None = None,
    stores: DataFrame | None = None,
    join_keys: Sequence[str] = JOIN_KEYS,
    dim_key: str = DIM_KEY,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Row-level merge: sales LEFT JOIN features on the three keys, LEFT JOIN stores on the store key.
    Key columns are merged (``USING`` semantics), as in the original. With ``rows_per_task`` heavy keys are
    spread over tasks (``spread_join``); the rows are the same."""
    def join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
        return left.join(right, list(on), "left") if rows_per_task is None else spread_join(left, right, on, rows_per_task)

    merged = sales
    if features is not None:
        merged = join(merged, features, join_keys)
    if stores is not None:
        merged = join(merged, stores, [dim_key])
    return merged


def calendar_features(df: DataFrame, date: str = "date") -> DataFrame:
    """Month and day of month as seasonal inputs."""
    return df.withColumns({
        "month": F.month(date).cast(T.IntegerType()),
        "day": F.dayofmonth(date).cast(T.IntegerType()),
    })


def covariate_pairs(covariates: Sequence[str] | Mapping[str, str]) -> list[tuple[str, str]]:
    """``(output name, input column)`` pairs; a mapping renames, a list keeps the names."""
    if isinstance(covariates, Mapping):
        return list(covariates.items())
    return [(c, c) for c in covariates]


def significant(c: F.Column, digits: int = SIGNIFICANT) -> F.Column:
    """A double rounded to so many significant digits; 0, null, NaN, infinities and values next to the
    limits of doubles stay as they are."""
    size = F.abs(c)
    power = F.pow(F.lit(10.0), F.floor(F.log10(size)) - F.lit(digits - 1))
    usual = (size > F.lit(1e-290)) & (size < F.lit(1e300))
    return F.when(usual, F.round(c / power) * power).otherwise(c)


def rollup_aggs(covariates: Sequence[str], holiday: F.Column, target: str = "total_sales",
                sales: str = "_sales", rows: str = "_rows") -> list[F.Column]:
    """Aggregates of the weekly roll-up over rows pre-aggregated to the join grain: the rounded sales
    total, covariate means weighted by sales rows (nulls excluded, as ``avg`` over the joined rows does),
    and the share of holiday rows.

    Means are taken in double like the original's ``avg``, for values of any size, and rounded to
    ``SIGNIFICANT`` digits at the end: the same value whatever the partitioning, so that model fits
    downstream are reproducible."""
    n = F.col(rows)
    aggs = [F.round(F.sum(sales)).cast(T.DoubleType()).alias(target)]
    for c in covariates:
        mean = F.try_divide(F.sum(F.col(c) * n), F.sum(F.when(F.col(c).isNotNull(), n)).cast(T.DoubleType()))
        aggs.append(significant(mean).alias(c))
    aggs.append((F.sum(holiday * n) / F.sum(n)).cast(T.DoubleType()).alias("is_holiday"))
    return aggs


def undated_sales(sales: DataFrame, date: str = "date") -> DataFrame:
    """The sales rows that ``weekly_panel(undated="reject")`` leaves out: rows whose date was missing or
    could not be read. Counting them is ``undated_sales(sales).count()``."""
    return sales.where(F.col(date).isNull())


def weekly_panel(
    sales: DataFrame,
    features: DataFrame | None = None,
    stores: DataFrame | None = None,
    keys: Sequence[str] = (),
    covariates: Sequence[str] | Mapping[str, str] = ("temp", "cpi"),
    holiday_values: Sequence[str] = ("true", "1"),
    normalize_flag: bool = True,
    join_keys: Sequence[str] = JOIN_KEYS,
    dim_key: str = DIM_KEY,
    target: str = "total_sales",
    calendar: bool = True,
    validate: bool = True,
    undated: str = "reject",
    fill: bool = False,
) -> DataFrame:
    """One row per (series keys, date): rounded sales total, covariate means over the joined sales
    rows, share of holiday rows, month and day.

    ``validate`` makes the plan fail if the covariates are not unique on the join keys or the dimension on
    its key (duplicates would multiply sales through the left joins, S18). Without it they multiply.

    ``undated`` says what happens to sales without a date, which belong to no week: "reject" leaves them out
    of every series (``undated_sales`` returns and counts them), "raise" fails the job, "keep" makes them a
    week of their own as the original does. ``fill`` inserts the missing weeks of every series.

    ``keys`` may name sales columns (e.g. ``store``, ``dept``) or dimension columns (e.g. ``nation``);
    an empty ``keys`` gives the single series of the original. ``covariates`` is a list of covariate
    columns or a mapping ``{output name: covariate column}``.
    """
    keys = list(keys)
    join_keys = list(join_keys)
    sales_side = [k for k in keys if k in sales.columns and k not in join_keys]
    dim_side = [k for k in keys if k not in sales.columns]
    grain = join_keys + sales_side

    if undated not in ("reject", "raise", "keep"):
        raise ValueError(f"undated must be 'reject', 'raise' or 'keep', not {undated!r}")
    if undated == "raise":
        missing = F.raise_error(F.lit("a sales row has no date")).cast(sales.schema["date"].dataType)
        sales = sales.withColumn("date", F.coalesce(F.col("date"), missing))
    elif undated == "reject":
        sales = sales.where(F.col("date").isNotNull())
    pre = sales.groupBy(*grain).agg(
        F.sum("weekly_sales").alias("_sales"),
        F.count(F.lit(1)).alias("_rows"),
    )
    pairs = covariate_pairs(covariates) if features is not None else []
    joined = pre
    if features is not None:
        cov = features.select(*join_keys, *[F.col(src).alias(out) for out, src in pairs])
        joined = joined.join(single_row(cov, join_keys, "covariates") if validate else cov, join_keys, "left")
    if dim_side:
        if stores is None:
            raise ValueError(f"series keys {dim_side} are not sales columns and no dimension was given")
        dim = stores.select(dim_key, *dim_side)
        joined = joined.join(single_row(dim, [dim_key], "dimension") if validate else dim, [dim_key], "left")

    if keys and dim_key in keys and not dim_side:
        # bounded rows per series (weeks x flags): hash them by series once; the roll-up and the
        # windows partitioned by the same keys then need no exchange of their own
        joined = joined.repartition(*keys)
    holiday = holiday_flag("flag", holiday_values, normalize_flag)
    aggs = rollup_aggs([out for out, _ in pairs], holiday, target)
    panel = joined.groupBy(*keys, "date").agg(*aggs)
    panel = calendar_features(panel) if calendar else panel
    return fill_weeks(panel, keys) if fill else panel


def fill_weeks(panel: DataFrame, keys: Sequence[str] = (), date: str = "date", step_days: int = 7) -> DataFrame:
    """Insert the missing periods of every series as rows with null measures, so that row lags become
    calendar lags (off by default: the original's lags are row lags, and rows simply slide over a gap).

    One pass: every row brings the periods that lie between it and the next row of its series, in steps of
    ``step_days`` from its own date. No row is dropped: one off the step, one without a date and one whose
    series key is null come back as they are. Calendar columns are filled for the new rows. Without keys the
    window holds one series, which the calendar bounds.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy(date) if keys else Window.orderBy(date)
    step = F.expr(f"INTERVAL {int(step_days)} DAYS")
    last = F.date_sub("_next", int(step_days))
    dates = F.when(last > F.col(date), F.sequence(F.col(date), last, step)).otherwise(F.array(F.col(date)))
    spread = panel.withColumn("_next", F.lead(date).over(order)).withColumn("_date", F.explode(dates))
    own = F.col("_date").eqNullSafe(F.col(date))
    measures = [c for c in panel.columns if c not in keys and c != date]
    filled = spread.select(*keys, F.col("_date").alias(date), *[F.when(own, F.col(c)).alias(c) for c in measures])
    if "month" in panel.columns or "day" in panel.columns:
        filled = calendar_features(filled.drop("month", "day"), date)
    return filled.select(*panel.columns)
