"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line.

Each query runs once to warm up and then three times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from polyquery.queries import load
from polyquery.session import session

HEADLINE = (
    "flagship_nation_revenue", "scan_projection", "filter_between", "join_three_way", "join_left", "join_many_to_many", "set_union", "distinct_on", "group_basic", "group_rollup",
    "agg_variance", "agg_median_percentile", "agg_regression", "win_running_sum", "win_range_frame", "win_lag_lead", "sub_correlated_max", "sub_exists", "sub_all", "lateral_join",
    "pivot_count", "openjson", "fn_date_format", "fn_str_regexp", "frame_groups", "frame_as_of_join", "dml_update_from", "stream_sessions",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
