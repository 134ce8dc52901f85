"""Run the whole flow and print the accuracy table.

    python -m weekcast --source catalog                      # tables sales / features / stores, retail layout
    python -m weekcast --source fixture --sf-dir /root/testdata/sf0.01 --preset reference

``catalog`` reads the three tables under their original names and column layout (dates as dd/MM/yyyy
text, ``NA`` for missing numbers) through the retail adapters; ``fixture`` maps the driver's TPC-H-like
tables onto the same roles. Both then build the weekly panel, the features of each horizon, and score
the models and the moving-average baseline.
"""

from __future__ import annotations

import argparse

from weekcast.config import PRESETS
from weekcast.operators.panel import undated_sales, weekly_panel
from weekcast.plans.report import accuracy_table, compare
from weekcast.session import get_session
from weekcast.sources.fixtures import COVARIATES, HOLIDAY_FLAGS, fixture_tables
from weekcast.sources.tables import catalog_tables, retail_features, retail_sales, retail_stores

RETAIL_PANEL_COVARIATES = {"temp": "temperature", "fuel_price": "fuel_price", "unemployment": "unemployment",
                           "cpi": "cpi"}


#: rows of the printed preview; the whole table goes to --out
PREVIEW = 40


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="weekcast")
    ap.add_argument("--source", choices=("catalog", "fixture"), default="catalog")
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--preset", choices=sorted(PRESETS), default="corrected")
    ap.add_argument("--horizons", default="1,2,3")
    ap.add_argument("--models", default="rf,dt,lr,gbt")
    ap.add_argument("--keys", default="", help="series keys, e.g. store or type (fixture: store or nation)")
    ap.add_argument("--fill", action="store_true", help="insert missing weeks, so that row lags are calendar lags")
    ap.add_argument("--out", default=None, help="write the whole table there as parquet; without it only a preview is printed")
    ap.add_argument("--master", default=None)
    args = ap.parse_args(argv)

    spark = get_session(master=args.master)
    keys = tuple(k for k in args.keys.split(",") if k)
    if args.source == "catalog":
        t = catalog_tables(spark)
        sales = retail_sales(t["sales"])
        print(f"sales rows without a readable date, left out: {undated_sales(sales).count()}")
        panel = weekly_panel(sales, retail_features(t["features"]), retail_stores(t["stores"]),
                             keys=keys, covariates=RETAIL_PANEL_COVARIATES, fill=args.fill)
    else:
        t = fixture_tables(spark, args.sf_dir)
        panel = weekly_panel(t["sales"], t["features"], t["stores"], keys=keys, covariates=COVARIATES,
                             holiday_values=HOLIDAY_FLAGS, normalize_flag=False, fill=args.fill)
    horizons = tuple(int(h) for h in args.horizons.split(","))
    long, _ = compare(panel, horizons=horizons, models=tuple(args.models.split(",")), preset=PRESETS[args.preset],
                      keys=keys)
    table = accuracy_table(long, horizons, keys)
    if args.out:
        table.write.mode("errorifexists").parquet(args.out)
        table = spark.read.parquet(args.out)
    rows = table.count()
    print(f"{rows} rows" + (f", all of them in {args.out}" if args.out else "") + (f"; the first {PREVIEW}:" if rows > PREVIEW else ":"))
    table.show(n=PREVIEW, truncate=False)


if __name__ == "__main__":
    main()
