"""Print a Markdown table of each registered query's physical plan shape.

Usage: python tools/plan_shapes.py [sf_dir]
Counts shuffles, aggregates, joins and other notable operators in the plan
Spark chose (before adaptive re-planning), so the README's scale claims can be
checked against the real plans.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

STORAGE = {"write_catalog", "land_daily", "read_landing", "read_hazard", "hazard_document", "sync", "live_stream",
           "stream_upsert", "stream_window_stats"}


def shape(plan: str) -> dict:
    lines = plan.splitlines()

    def count(pat):
        return sum(1 for ln in lines if re.search(pat, ln))

    return {
        "shuffles": count(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)"),
        "single": count(r"Exchange SinglePartition"),
        "hash_agg": count(r"HashAggregate\("),
        "sort_agg": count(r"SortAggregate\("),
        "bhj": count(r"BroadcastHashJoin"),
        "smj": count(r"SortMergeJoin"),
        "topk": count(r"TakeOrderedAndProject"),
        "window": count(r"^\W*Window "),
        "generate": count(r"Generate "),
        "subquery": count(r"^\W*Subquery "),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from tectonic.session import local_session
    from tectonic.suite import QUERIES

    spark = local_session(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")   # show the static plan
    cols = ["shuffles", "single", "hash_agg", "sort_agg", "bhj", "smj", "topk", "window", "generate", "subquery"]
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for name in sorted(QUERIES):
        if name in STORAGE:
            continue
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        s = shape(plan)
        print(f"| `{name}` | " + " | ".join(str(s[c]) for c in cols) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
