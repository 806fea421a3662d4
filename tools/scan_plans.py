"""Scan the physical plan of every registered query for cross products and row-at-a-time
Python UDFs. Usage: python tools/scan_plans.py [sf_dir]  (stream runs are skipped)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ferret.plans.catalog import REGISTRY  # noqa: E402
from ferret.session import build_session  # noqa: E402

STREAM_RUNS = {"h01_resource_stream", "h04_first_per_url_stream", "a05_stream_upsert",
               "h03_percolate_stream"}
FLAGS = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session()
    found = 0
    for name, (fn, _) in sorted(REGISTRY.items()):
        if name in STREAM_RUNS:
            continue
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        hits = [f for f in FLAGS if f in plan]
        if hits:
            found += 1
            print(name, hits)
    print(f"queries with flagged operators: {found}")
    spark.stop()


if __name__ == "__main__":
    main()
