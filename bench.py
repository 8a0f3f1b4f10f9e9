"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries",
"sf"}.  Each query runs once on the tiny sf0.001 tables to warm the JVM,
code generation and Python workers, then is timed once at the target scale.
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.plans.queries import QUERIES  # noqa: E402
from quire.session import local_session  # noqa: E402

HEADLINE = ["pack_totals", "split_by_tokens", "drop_low_priority", "cost_comparison", "render_markdown",
            "optimize_context", "file_tree", "debounced_changes"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="quire-bench")
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):                       # JVM / codegen / Python worker warm-up on tiny data
        for name in names:
            QUERIES[name](spark, warm).collect()
    times = {}
    for name in names:
        t = time.time()
        QUERIES[name](spark, sf_dir).collect()
        times[name] = round(time.time() - t, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
