"""Benchmark: wall-clock seconds of the headline queries, as one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS`` (default
8) choose the data and the cores; names given as arguments replace the list.
"""

from __future__ import annotations

import json
import os
import sys
import time

from loadsig.plans.catalog import QUERIES, events_cal
from loadsig.plans.portfolio import characterise
from loadsig.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "d10_outliers_by_month",
    "d7_fit_changepoint",
    "d6_best_candidate",
    "r2_repair",
    "d13_model_metrics",
    "d16_box_stats_coldest_month",
    "d12_cluster_profiles",
    "m1_kmeans_days",
    "m5_silhouette",
    "m8_fit_tree",
    "p1_predict_load",
    "p2_score_stream",
]
WHOLE = "whole_characterisation"


def run(spark, name: str) -> None:
    if name == WHOLE:
        df = characterise(events_cal(spark, SF_DIR)).metrics
    else:
        df = QUERIES[name](spark, SF_DIR)
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("OFF")
    # start-up of the JVM and of the first tasks is not part of any query
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").groupBy("l_suppkey").count().count()
    seconds = {}
    for name in sys.argv[1:] or [*HEADLINE, WHOLE]:
        begin = time.perf_counter()
        run(spark, name)
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
