"""Write the physical plans of the headline queries to docs/plans.md.

Broadcast thresholds are switched off first, so the plans show what a 100 TB run gets when no side is
small: sort-merge joins and the exchanges they need.

    python tools/plans.py /root/testdata/sf0.1
"""

from __future__ import annotations

import contextlib
import io
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from weekcast.config import CORRECTED, REFERENCE  # noqa: E402
from weekcast.operators.features import build_features  # noqa: E402
from weekcast.queries import panel  # noqa: E402
from weekcast.session import get_session  # noqa: E402


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("simple")
    return buf.getvalue().strip()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    cases = {
        "weekly_panel (one series)": panel(spark, sf_dir),
        "features h=1, one series (REFERENCE)": build_features(panel(spark, sf_dir), 1, (), REFERENCE),
        "features h=1, one series per supplier (CORRECTED)":
            build_features(panel(spark, sf_dir, ("store",)), 1, ("store",), CORRECTED),
        "weekly_panel keyed by nation (store dimension broadcast after a bounded count)":
            panel(spark, sf_dir, ("nation",)),
    }
    out = ["# Physical plans", "",
           "Generated by `tools/plans.py` with broadcast joins disabled (the 100 TB case: no side is small).",
           "Read bottom-up: one scan per source, a partial aggregate before every exchange of fact rows,",
           "a sort-merge join with no exchange of its own (both inputs are already hash-partitioned on",
           "store, date, flag), then one exchange and one sort for all window steps of a horizon.", ""]
    for name, df in cases.items():
        out += [f"## {name}", "", "```", plan(df), "```", ""]
    with open(__file__.rsplit("/tools/", 1)[0] + "/docs/plans.md", "w") as fh:
        fh.write("\n".join(out))


if __name__ == "__main__":
    main()
