"""Time the headline queries on BENCH_SF_DIR with local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "returns_and_legs", "instrument_features", "asof_backward", "asof_vintage", "event_window_join", "ledger_summary", "rolling_review",
    "sign_auc", "block_bootstrap", "trailing_q_path", "hit_dedup_stream", "daily_traffic", "term_ranking", "walk_forward_folds", "ridge_fold",
    "har_sigma",
]


def main() -> None:
    from tidemark import plans
    from tidemark.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, max(8, int(cpus)), "12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.queries()
    names = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
