"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS
(default 8) the threads. Each query runs once to warm up and BENCH_RUNS
(default 2) times more, all rows computed and dropped; the least time counts.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from semiweave.queries import QUERIES

HEADLINE = [
    "supplier_similarity", "from_coo_plus", "from_coo_times", "mxm_plus_times", "mxm_min_plus", "mxm_mask_struct", "mxm_mask_comp", "mxm_t0", "mxv_plus_times", "vxm_plus_times",
    "ewise_add_plus", "ewise_mult_times", "reduce_rows_plus", "reduce_cols_plus", "transpose", "matrix_set", "matrix_extract", "bfs_levels", "bfs_reach", "sssp", "triangle_count",
    "connected_components", "degree_out", "pagerank", "fixed_point_info", "traverse_count", "traverse_cheapest", "closure_lor_land",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + runs):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
            spark.catalog.clearCache()
        seconds[name] = round(min(times[1:]), 3)
    print(json.dumps({"metric": "total seconds of the headline queries, least of the warm runs", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
