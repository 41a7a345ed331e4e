"""Summarise the final (adaptive) physical plan of every registered query.

Usage: python scripts/plan_summary.py [sf_dir] > PLANS.md

Each query's own plan is executed once so the adaptive plan is final (the
"Final Plan" section: AQE's runtime join choices, coalescing and stage
reuse), then its operators are counted: shuffles by kind, join strategies, partial
aggregations, scans and the filters pushed into them.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def summarise(plan: str) -> dict:
    count = lambda pat: len(re.findall(pat, plan))
    pushed = sorted({p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if p})
    return {
        "hash": count(r"Exchange hashpartitioning"),
        "range": count(r"Exchange rangepartitioning"),
        "single": count(r"Exchange SinglePartition"),
        "bcast": count(r"BroadcastExchange"),
        "reused": count(r"ReusedExchange"),
        "bhj": count(r"BroadcastHashJoin"),
        "smj": count(r"SortMergeJoin"),
        "shj": count(r"ShuffledHashJoin"),
        "partial": count(r"HashAggregate\(keys=\[[^\]]*\], functions=\[partial_"),
        "window": count(r"\bWindow\b"),
        "topk": count(r"TakeOrderedAndProject"),
        "scans": count(r"FileScan parquet|Scan parquet"),
        "pushed": pushed,
    }


def main(argv) -> None:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from sellerlens import catalog
    from sellerlens.session import local_session
    spark = local_session(8, shuffle_partitions=16)
    print(f"# Final physical plans at {sf_dir} (local[8], AQE on)\n")
    print("Shuffles: hash / range / single-partition exchanges; bcast: broadcast "
          "exchanges (AQE picks them from measured sizes); reused: shared shuffles; "
          "BHJ/SMJ: join strategies; partial: map-side aggregations before a shuffle; "
          "scans: Parquet scans. `Window` is never used.\n")
    print("| query | hash | range | single | bcast | reused | BHJ | SMJ | partial agg | top-k | scans | filters pushed into scans |")
    print("|---|---|---|---|---|---|---|---|---|---|---|---|")
    for name, fn in catalog.QUERIES.items():
        df = fn(spark, sf_dir)
        df._jdf.queryExecution().toRdd().count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        s = summarise(final)
        pushed = "; ".join(p.replace("|", "\\|") for p in s["pushed"])[:220]
        print(f"| {name} | {s['hash']} | {s['range']} | {s['single']} | {s['bcast']} | {s['reused']} | "
              f"{s['bhj']} | {s['smj']} | {s['partial']} | {s['topk']} | {s['scans']} | {pushed} |")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
