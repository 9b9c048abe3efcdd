"""Times the headline queries once warm; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tidemark.queries import QUERIES

HEADLINE = ("daily_return", "range_window_join", "knowable_date", "asof_backward", "rolling_z", "rolling_skew_kurt", "rank_pct_avg", "micro_daily", "smile_statistics", "implied_volatility", "kalman", "buy_hold_backtest", "rank_ic", "futures_labels")


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.time()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d).removeprefix("sf")}))


if __name__ == "__main__":
    main()
