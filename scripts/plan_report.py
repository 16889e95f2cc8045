"""Summarise the physical plan of every query: joins, exchanges, scans.

usage: python scripts/plan_report.py [sf_dir] [name ...]
Runs each query and prints, from AQE's final plan, one line per query with
exchange / reused-exchange / broadcast / join counts, any nested-loop or
cartesian join, and the columns each parquet scan reads with its pushed
filters.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from covary.plans import queries  # noqa: E402
from covary.session import local_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8, 8)
    for name, fn in queries().items():
        if names and name not in names:
            continue
        df = fn(spark, sf)
        df.collect()   # run the DataFrame's own execution so AQE's final plan is reported
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        kinds = {k: len(re.findall(k, plan)) for k in
                 ("Exchange hashpartitioning", "ReusedExchange", "BroadcastExchange", "SortMergeJoin",
                  "BroadcastHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "FileScan")}
        flags = [k for k in ("BroadcastNestedLoopJoin", "CartesianProduct") if kinds[k]]
        scans = sorted(set(re.findall(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", plan)))
        print(f"{name}: " + ", ".join(f"{k.split()[0]}={v}" for k, v in kinds.items() if v)
              + (f"  !! {flags}" if flags else ""))
        for cols, pushed in scans:
            cols = re.sub(r"#\d+L?", "", cols)
            print(f"    scan [{cols}] pushed [{re.sub(r'#[0-9]+L?', '', pushed)}]")


if __name__ == "__main__":
    main()
