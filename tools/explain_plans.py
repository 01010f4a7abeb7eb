"""Summarise the physical plan of every registered query (operator counts).

Usage: python tools/explain_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuslens.plans.registry import all_queries as queries  # noqa: E402
from corpuslens.session import get_session  # noqa: E402

OPS = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition",
       "Exchange RoundRobinPartitioning", "BroadcastExchange", "SortMergeJoin", "ShuffledHashJoin",
       "BroadcastHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "Generate",
       "MapInPandas", "FlatMapGroupsInPandas", "ArrowEvalPython", "BatchEvalPython", "Subquery",
       "TakeOrderedAndProject", "InMemoryTableScan"]
SHORT = {"Exchange hashpartitioning": "hashX", "Exchange rangepartitioning": "rangeX",
         "Exchange SinglePartition": "singleX", "Exchange RoundRobinPartitioning": "rrX",
         "BroadcastExchange": "bcastX", "SortMergeJoin": "SMJ", "ShuffledHashJoin": "SHJ",
         "BroadcastHashJoin": "BHJ", "BroadcastNestedLoopJoin": "BNLJ", "CartesianProduct": "Cartesian",
         "Window": "Window", "Generate": "Generate", "MapInPandas": "mapInPandas",
         "FlatMapGroupsInPandas": "applyInPandas", "ArrowEvalPython": "pandasUDF",
         "BatchEvalPython": "pythonUDF", "Subquery": "scalarSubq", "TakeOrderedAndProject": "topN",
         "InMemoryTableScan": "cached"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session()
    qs = queries()
    print("| query | operators in the physical plan | scans (columns read) |")
    print("|---|---|---|")
    for name in sorted(qs):
        df = qs[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = []
        for op in OPS:
            n = len(re.findall(re.escape(op), plan))
            if op == "Subquery":
                n = len(re.findall(r"\bSubquery subquery", plan))
            if n:
                counts.append(f"{SHORT[op]}×{n}")
        schemas = sorted(set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)))
        cols = "; ".join(",".join(c.split(":")[0] for c in s.split(",")) for s in schemas)
        print(f"| {name} | {' '.join(counts)} | {cols} |")


if __name__ == "__main__":
    main()
