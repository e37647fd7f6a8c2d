"""Summarise the physical plan of every catalogue query (after AQE) into PLANS.md.

    python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict[str, object]:
    return {
        "scans": len(re.findall(r"(FileScan|Scan) parquet", plan)),
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin", plan)),
        "single": plan.count("Exchange SinglePartition"),
        "bhj": plan.count("BroadcastHashJoin"),
        "smj": plan.count("SortMergeJoin"),
        "shj": plan.count("ShuffledHashJoin"),
        "windows": len(re.findall(r"\bWindow\b \[", plan)),
        "python": "yes" if re.search(r"FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython", plan) else "",
        "pushed": ", ".join(sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan))))[:70],
    }


def main() -> None:
    from trialstats.session import local_session
    from trialstats.plans import catalog

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    print("# PLANS\n")
    print(f"Physical plans of every query after execution (AQE final plans), at `{sf}` on `local[8]`.")
    print("Generated by `tools/plan_report.py`. Columns: parquet scans, hash/range shuffles, single-partition")
    print("exchanges (final step of a global aggregate), broadcast-hash / sort-merge / shuffled-hash joins,")
    print("window operators, Python in the plan, filters pushed into the scan.\n")
    print("| Query | Scans | Shuffles | Single | BHJ | SMJ | SHJ | Windows | Python | Pushed filters |")
    print("|---|---|---|---|---|---|---|---|---|---|")
    for name, fn in sorted(catalog.queries().items()):
        df = fn(spark, sf)
        df.collect()  # runs this frame's own plan, so that the one read below is final
        plan = df._jdf.queryExecution().executedPlan().toString()
        if "isFinalPlan=false" in plan:
            raise RuntimeError(f"{name}: the plan is not final")
        s = summarise(plan.split("== Initial Plan ==")[0])
        print(f"| {name} | {s['scans']} | {s['shuffles']} | {s['single']} | {s['bhj']} | {s['smj']} | {s['shj']} "
              f"| {s['windows']} | {s['python']} | {s['pushed']} |")


if __name__ == "__main__":
    main()
