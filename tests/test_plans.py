"""Physical plans: no row-wise Python, no cross joins, pruned scans."""

import pytest

from farescope.catalog.base import run

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return run(spark, SF, name)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["diff_columns", "compare_scrapes", "risk_features", "monitor_cells", "inventory_states",
                                  "backtest_metrics", "threshold_sweep", "latest_two_full_cycles", "flatten_gds_offers"])
def test_core_stays_on_the_jvm(spark, name):
    text = plan(spark, name)
    for bad in ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_group_limit_before_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "dedup_core")


def test_scan_reads_needed_columns_only(spark):
    text = plan(spark, "threshold_sweep")
    scans = [line for line in text.splitlines() if "ReadSchema" in line]
    assert scans and all("l_shipdate" not in line for line in scans)


def test_overall_and_grouped_figures_in_one_read(spark):
    from farescope.operators import forecast

    rows = [("A", None, 1.0, 2.0, 0.5), ("A", "X", 3.0, 2.5, 1.0), ("B", "X", 2.0, 2.0, 4.0), ("B", None, None, 2.0, 4.0)]
    df = spark.createDataFrame(rows, "airline string, origin string, actual double, pred_m double, prev_actual_value double")
    long = forecast.long_predictions(df, "actual", ["pred_m"], ["airline", "origin"])
    both = forecast.error_metrics_sets(long, ["airline", "origin"])
    text = both._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Expand") == 1 and text.count("Aggregate") == 1
    overall, series = forecast.evaluate(df, "actual", ["pred_m"], ["airline", "origin"])
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, overall.collect())) == sorted(map(key, forecast.error_metrics(long).collect()))
    assert sorted(map(key, series.collect())) == sorted(map(key, forecast.error_metrics(long, ["airline", "origin"]).collect())) and series.count() == 4
