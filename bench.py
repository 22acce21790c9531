"""Headline queries on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_weighted_top20", "t02_macd", "t03_rsi", "t04_kdj", "t16_panel_series", "t17_library_volume", "v12_mainforce_resonance",
    "k08_cost_peak", "k14_market_state", "c03_c04_overall", "g01_key_levels", "g07_cvd", "j07_asof_forward_entry_exit", "j08_range_join",
    "a04_a05_quantiles", "l03_l05_retention", "e04_e09_ic_summary", "e06_long_short_summary", "r02_tracking", "r06_cohort_backtest",
    "n01_n02_ratios", "d01_d02_bar_suite", "m02_enhanced_score", "st04_tick_bars_1m"]


def main() -> None:
    from tidemark.plans import load
    from tidemark.session import local_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries, _ = load()
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the executors
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
