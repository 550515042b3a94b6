"""Times the headline queries over a built search index; prints one JSON line.

The index is built once and its time given apart; a query's time is the median of RUNS runs
after a warm-up run, with the 95th percentile (nearest rank) beside it.
"""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

from folioframe.driver_queries import QUERIES, search_index  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 5
HEADLINE = (
    "b6_bm25_one_term", "b6_bm25_rare_term", "b3_bm25_all_terms", "b4_bm25_phrase", "b5_bm25_prefix", "f1_tags_has", "f2_tags_has_any", "f4_date_range", "f10_number_range",
    "q4_search_filtered_page", "j9_resolve_links", "p2_structural_paths", "o5_tree_dfs", "j7_reconcile", "t3_last_event_wins", "j4_semi_and_existence",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    began = time.perf_counter()
    search_index(spark, SF_DIR)
    built = time.perf_counter() - began
    took, p95 = {}, {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS + 1):  # the first compiles, the others count
            began = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        runs = sorted(runs[1:])
        took[name], p95[name] = round(runs[len(runs) // 2], 4), round(runs[-(-95 * len(runs) // 100) - 1], 4)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "p95": p95, "index_build": round(built, 3), "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
