"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hindcast.plans.registry import load_all
from hindcast.session import session

HEADLINE = [
    "w00_slice_top3_by_person_form", "w01_lags", "w04_trailing_mean", "w07_expanding_stats", "w10_days365_rates",
    "w14_before_group", "w17_ewm_adjusted", "w28_sessions", "w40_hierarchical_smoothing", "w42_speed_index",
    "w23_w24_w26_standing", "w47_ratings", "j02_asof_with_tolerance", "j04_j27_multi_offset", "j19_kernel_sum",
    "j20_head_to_head", "d01_exacta", "d05_place", "d09_candidates", "d13_portfolio", "d20_d22_settlement", "d26_placebo",
    "a17_auc", "a21_ndcg_recall", "a28_ks_statistic", "a32_bootstrap_interval", "a34_d25_parameter_sweep",
    "s17_a24_entity_summary", "b_history_stats", "b_temporal_stats",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = load_all()
    only = sys.argv[1:]
    times: dict[str, float] = {}
    spark.read.parquet(f"{sf}/orders.parquet").count()  # start the executors
    for name in only or HEADLINE:
        if name not in found:
            continue
        t = time.perf_counter()
        found[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
