"""Summarise the final physical plan of every registered query.

    python tools/plan_summary.py [--sf /root/testdata/sf0.01] > docs/PLANS.md

For each query: exchanges by kind, aggregate and join strategies, windows,
generators, subqueries, and per scan the columns read and the filters pushed
to parquet. Plans that start from "ExistingRDD" read the checkpoint of a small
aggregate, whose own plan is that of ``valuation.daily_activity`` or of the
distinct days in ``prices.price_gaps``.
"""

from __future__ import annotations

import argparse
import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(txt: str) -> dict:
    c = collections.Counter()
    for line in txt.split("\n"):
        s = line.strip(" :+-")
        for kind in ("HashAggregate", "SortAggregate", "ObjectHashAggregate", "SortMergeJoin", "BroadcastHashJoin",
                     "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "Generate",
                     "BroadcastExchange", "Union", "TakeOrderedAndProject"):
            if s.startswith(kind + " ") or s.startswith(kind + "(") or s == kind:
                c[kind] += 1
        m = re.search(r"Exchange (hashpartitioning|RoundRobinPartitioning|SinglePartition|rangepartitioning)", line)
        if m:
            c["Exchange " + m.group(1)] += 1
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", txt)
    return {"ops": c, "scans": scans, "subqueries": txt.count("Subquery ") + txt.count("SubqueryBroadcast")}


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    a = ap.parse_args()
    from coffer.plans.catalog import REGISTRY
    from coffer.session import build_session

    spark = build_session("plan-summary", shuffle_partitions=16)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_summary.py --sf {a.sf}` (final adaptive plans, 16 shuffle partitions).")
    print("A round-robin of `spark.sql.shuffle.partitions` before a `Generate` is the calendar spreading.\n")
    print("| query | exchanges | aggregates | joins | window / generate / subquery |")
    print("|---|---|---|---|---|")
    details = []
    for name, query in REGISTRY.items():
        df = query.build(spark, a.sf)
        df.write.format("noop").mode("overwrite").save()
        txt = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(txt)
        o = s["ops"]
        ex = ", ".join(f"{k.split(' ', 1)[1]}×{v}" for k, v in sorted(o.items()) if k.startswith("Exchange ")) or "—"
        if o["BroadcastExchange"]:
            ex += f", broadcast×{o['BroadcastExchange']}"
        ag = ", ".join(f"{k}×{o[k]}" for k in ("HashAggregate", "ObjectHashAggregate", "SortAggregate") if o[k]) or "—"
        jn = ", ".join(f"{k}×{o[k]}" for k in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
                                               "BroadcastNestedLoopJoin", "CartesianProduct") if o[k]) or "—"
        wg = f"{o['Window']} / {o['Generate']} / {s['subqueries']}"
        print(f"| `{name}` | {ex} | {ag} | {jn} | {wg} |")
        details.append((name, s["scans"]))
    print("\n## Scans: columns read and filters pushed to parquet\n")
    for name, scans in details:
        seen = set()
        for cols, pushed in scans:
            cols = re.sub(r"#\d+L?", "", cols)
            key = (cols, pushed)
            if key in seen:
                continue
            seen.add(key)
            print(f"- `{name}`: [{cols}] pushed [{re.sub(r'#\d+L?', '', pushed)}]")
    spark.stop()


if __name__ == "__main__":
    main()
