"""Time the headline queries: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

from farescope.catalog.base import load_all, run
from farescope.session import build_session, use_local_work_dir

HEADLINE = [
    "cycle_runs", "latest_two_full_cycles", "route_daily_fare", "dq_nulls", "tax_monitor_routes", "compare_scrapes",
    "finalize_comparison", "diff_columns", "route_airline_summary", "risk_features", "change_largest_moves", "monitor_matrix",
    "operations_routes", "competitive_position", "offer_trend", "externalize_duplicates", "flatten_gds_offers",
    "inventory_states", "inventory_next_labels", "baseline_predictions", "backtest_metrics", "threshold_sweep",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false",
    })
    use_local_work_dir(spark)
    load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(spark, sf_dir, name).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
