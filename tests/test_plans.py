"""Plan shape at scale: broadcasts off, as when no side is small."""

import contextlib
import io

import pytest

from conftest import SF_SMALL
from weekcast.config import CORRECTED
from weekcast.operators.features import build_features
from weekcast.queries import panel


@pytest.fixture
def no_broadcast(spark):
    old = (spark.conf.get("spark.sql.autoBroadcastJoinThreshold"),
           spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
    if old[1] is None:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    else:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", old[1])


def _ops(df) -> list[str]:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("simple")
    ops = []
    for line in buf.getvalue().splitlines():
        body = line.lstrip(" :+-")
        # row-wise steps change no partitioning
        if body and not body.startswith(("==", "AdaptiveSparkPlan", "Project", "Filter")):
            ops.append(body.split(" ")[0].split("(")[0])
    return ops


def test_join_adds_no_exchange(no_broadcast):
    ops = _ops(panel(no_broadcast, SF_SMALL))
    j = ops.index("SortMergeJoin")
    # the join's two inputs are sorted aggregates, not exchanges
    assert ops[j + 1] == "Sort" and ops[j + 2] == "HashAggregate"
    right = [i for i in range(j + 3, len(ops)) if ops[i] == "Sort"][0]
    assert ops[right + 1] == "HashAggregate"


def test_every_exchange_of_fact_rows_follows_a_partial_aggregate(no_broadcast):
    ops = _ops(panel(no_broadcast, SF_SMALL))
    j = ops.index("SortMergeJoin")
    for i, op in enumerate(ops[j:], start=j):
        if op == "Exchange":
            assert ops[i + 1] == "HashAggregate", ops[i:i + 3]


def test_per_store_features_one_exchange_after_join(no_broadcast):
    keys = ("store",)
    df = build_features(panel(no_broadcast, SF_SMALL, keys), 1, keys, CORRECTED)
    ops = _ops(df)
    j = ops.index("SortMergeJoin")
    assert ops[:j].count("Exchange") == 1
    assert ops[:j].count("Sort") == 1


def test_scan_prunes_columns_and_pushes_the_filter(no_broadcast):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        panel(no_broadcast, SF_SMALL).explain("formatted")
    text = buf.getvalue()
    assert "l_comment" not in text and "l_orderkey" not in text and "l_quantity" not in text


def test_one_fact_exchange_on_each_side_of_the_join(no_broadcast):
    """A sales row is a lineitem row: its partial aggregate feeds the only exchange before the join."""
    ops = _ops(panel(no_broadcast, SF_SMALL))
    j = ops.index("SortMergeJoin")
    assert ops[j:].count("Exchange") == 2 and ops[j:].count("FileScan") == 2


def test_dimension_join_is_sort_merge_without_a_broadcast_threshold(no_broadcast):
    from weekcast.operators.panel import merge_tables
    from weekcast.queries import tables

    t = tables(no_broadcast, SF_SMALL)
    ops = _ops(merge_tables(t["sales"], None, t["stores"]))
    j = ops.index("SortMergeJoin")
    assert ops[j:].count("Exchange") == 2 and "BroadcastHashJoin" not in ops


def test_filled_panel_scans_the_facts_twice(spark):
    from weekcast.operators.panel import fill_weeks

    assert _ops(fill_weeks(panel(spark, SF_SMALL, ("store",)), ("store",))).count("FileScan") == 2


def test_registered_queries_read_the_given_tables(spark):
    """Every SQL-checked query is a plan over the driver's parquet files, with no local relation."""
    from weekcast.oracle import ORACLE
    from weekcast.queries import REGISTRY as q

    # coefficients of an MLlib fit over the tables, returned as a one-row frame (checked against SQL's
    # closed form); the fit itself reads the tables
    model_outputs = {"lr_single_feature"}
    model_outputs |= {n for n in ORACLE if n.startswith(("cv_results_", "best_params_", "accuracy_comparison_",
                                                               "feature_", "predict_", "model_run_"))}
    # materialized between positions (or counts) and use: a checkpoint hides the scan
    model_outputs |= {"features_h1_by_ranges", "sma_by_ranges", "ts_split_raw", "merge_left_dimension_spread"}
    for name in sorted(set(ORACLE) - model_outputs):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            q[name](spark, SF_SMALL).explain("simple")
        text = buf.getvalue()
        assert "FileScan parquet" in text, name
        assert "lineitem.parquet" in text or "supplier.parquet" in text, name
        assert "LocalTableScan" not in text, name
