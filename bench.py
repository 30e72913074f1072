"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` (comma
separated) another selection. Every query starts from the raw tables.
"""
from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from driftmark.plans.catalogue import QUERIES
from driftmark.session import discard_tables

HEADLINE = (
    "event_car", "car_paths", "ic_by_season", "pooled_spearman", "quantile_hit_rate", "history_midrank",
    "event_time_returns", "entry_delay_sweep", "seasonal_holdings", "book_performance", "one_factor_regression",
    "lm_tone", "mask_identity", "html_to_text", "parsed_answers", "scored_documents", "signal_delta",
    "filing_selection", "weighted_kappa", "bootstrap_kappa_ci", "backtest_summary")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("driftmark-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").count()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name:28s} {times[name]:8.2f}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    discard_tables(spark)
    spark.stop()


if __name__ == "__main__":
    main()
