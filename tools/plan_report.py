"""Summarise the physical plan of every registered query into PLANS.md.

For each query of the library: shuffle exchanges with their partitioning keys, broadcast
exchanges, aggregate operators by kind, window operators, scans and reused exchanges of
the final plan, after execution, with nothing broadcast (a stand-in for large tables).  Usage:
    python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def summarise(plan: str) -> dict:
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)
    keys = [", ".join(re.sub(r"#\d+L?", "", k).split(", ")) for k in keys]
    return {
        "shuffles": keys,
        "single": plan.count("Exchange SinglePartition"),
        "broadcast": plan.count("BroadcastExchange"),
        "hash_agg": len(re.findall(r"\bHashAggregate\(", plan)),
        "sort_agg": len(re.findall(r"\bSortAggregate\(", plan)),
        "windows": len(re.findall(r"\bWindow \[", plan)) + len(re.findall(r"\bWindowGroupLimit", plan)),
        "group_limit": len(re.findall(r"WindowGroupLimit", plan)),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "scans": len(re.findall(r"FileScan parquet|Scan parquet", plan)),
        "reused": plan.count("ReusedExchange"),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from fleetlog.plans import fixture_queries
    from fleetlog.session import get_session

    spark = get_session("local[8]", 8)
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_report.py` on `{sf_dir}` (final plans after execution, both broadcast thresholds off).")
    print("Shuffle keys show how each stage partitions; `_bucket` is the time bucket of the")
    print("skew-safe ordered operators, `_kid` all keys as one column.\n")
    print("| query | shuffles (partition keys) | bcast | hash agg | sort agg | windows | SMJ | BHJ | scans | reused |")
    print("|---|---|---|---|---|---|---|---|---|---|")
    for name, fn in fixture_queries.queries().items():
        if name.startswith("stream_"):
            continue
        df = fn(spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        s = summarise(plan)
        shuffles = "; ".join(f"`{k}`" for k in s["shuffles"]) or "-"
        if s["single"]:
            shuffles += f"; single x{s['single']}"
        print(f"| {name} | {shuffles} | {s['broadcast']} | {s['hash_agg']} | {s['sort_agg']} | {s['windows']} | "
              f"{s['smj']} | {s['bhj']} | {s['scans']} | {s['reused']} |")


if __name__ == "__main__":
    main()
