"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from pyspark.sql import SparkSession  # noqa: E402

from spendloom.catalog import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = ["a3_attribution_rollup", "a4_slo_sli", "a5_task_ledger", "a6_waste_memo", "a9_cache_metrics", "a14_identical_actions", "w1_sessions", "w8_cusum", "w12_silent_runs", "w17_edit_thrash", "j6_symbol_edges", "j8_skill_overlap", "j11_ancestor_charges", "t10_injection_scan", "t11_secret_scan", "r7_keyword_search", "r8_markov", "r1_pagerank", "w21_hash_chain", "w21_verify_chain"]
RUNS = 3


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINES:
        times = []
        for _ in range(RUNS + 1):  # the first warms up
            began = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()
