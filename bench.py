"""Benchmark the headline queries.

Runs each query of ``HEADLINE`` on ``$BENCH_SF_DIR`` (default
``/root/testdata/sf0.1``) with ``local[$BENCH_CPUS]`` and prints one JSON
line.  Each query is executed in full through the ``noop`` sink (every row
computed, nothing collected to the driver), twice: ``queries`` holds the
first (cold) run, ``queries_warm`` the second.  What a run wrote is deleted
after it, so neither run reads another's work.  The inputs are loaded once
before, as a job would; ``load_inputs`` is the time of that, JVM warm-up
included, and is not part of the total.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from affinity.plans.catalog import QUERIES  # noqa: E402
from affinity.session import build_session, release, written  # noqa: E402

HEADLINE = [
    "item_popularity",
    "tag_dist_user",
    "tag_dist_city",
    "sampled_tags_user",
    "recommend_user",
    "recommend_city",
    "recommend_user_all",
    "recommend_city_all",
    "recommend_user_two_window",
    "recommend_city_two_window",
    "precision_user",
    "kl_summary",
    "weekly_drift",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                          app="affinity-bench", extra={"spark.driver.memory": "16g"})
    start = time.perf_counter()
    QUERIES["history_clean"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    load = round(time.perf_counter() - start, 3)
    inputs = written(spark)
    times, warm = {}, {}
    for name in names:
        for runs in (times, warm):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs[name] = round(time.perf_counter() - start, 3)
            release(spark, since=inputs)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    # value / queries: first run of each query (plan building, code
    # generation and execution); queries_warm: a second run
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus,
                      "warm_total": round(sum(warm.values()), 3), "queries_warm": warm,
                      "load_inputs": load}))
    spark.stop()


if __name__ == "__main__":
    main()
