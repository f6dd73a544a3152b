"""Summarise the physical plan of every registered query (for PLANS.md).

Usage: python scripts/plan_report.py [sf_dir] > PLANS.md
Counts exchanges by kind, join strategies, windows and generators, and lists
what reaches each Parquet scan (pushed filters, read schema).
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veilgrid.plans.registry import QUERIES  # noqa: E402
from veilgrid.session import get_session  # noqa: E402

KINDS = {
    "hash shuffle": r"^Exchange hashpartitioning",
    "range shuffle": r"^Exchange rangepartitioning",
    "round-robin shuffle": r"^Exchange RoundRobinPartitioning",
    "single-partition shuffle": r"^Exchange SinglePartition",
    "broadcast": r"BroadcastExchange",
    "sort-merge join": r"SortMergeJoin",
    "broadcast hash join": r"BroadcastHashJoin",
    "nested-loop join": r"BroadcastNestedLoopJoin",
    "cartesian": r"CartesianProduct",
    "window": r"\bWindow\b",
    "generate": r"\bGenerate\b",
    "python udf": r"(BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas)",
}


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", shuffle_partitions=16)
    print("# PLANS\n")
    print(f"Initial physical plans (AQE may still re-plan at run time) of the queries outside llm/ on `{sf_dir}`,")
    print("from `python scripts/plan_report.py`. Counts are operators in the formatted plan (the graph section);")
    print("a streaming query shows the plan of the batch read of its output.\n")
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        txt = plan_text(df)
        graph = txt.split("\n\n\n")[0]
        blocks = re.findall(r"^\(\d+\) (.+?)$(.*?)(?=^\(\d+\)|\Z)", txt, flags=re.M | re.S)
        labels = []
        for head, body in blocks:
            head = re.sub(r" \[codegen id : \d+\]", "", head).strip()
            if head == "Exchange":
                arg = re.search(r"Arguments: (\w+)", body)
                head = f"Exchange {arg.group(1) if arg else ''}"
            labels.append(head)
        counts = {k: sum(1 for d in labels if re.search(p, d)) for k, p in KINDS.items()}
        scans = re.findall(r"^\(\d+\) Scan parquet.*?\n(.*?)(?=^\(\d+\)|\Z)", txt, flags=re.M | re.S)
        print(f"## {name}\n")
        shown = ", ".join(f"{v} {k}" for k, v in counts.items() if v) or "no shuffle, no join"
        print(f"- operators: {shown}")
        for s in scans:
            loc = re.search(r"Location: \S+ \[(.*?)\]", s)
            pf = re.search(r"PushedFilters: (\[.*?\])", s)
            rs = re.search(r"ReadSchema: (struct<.*?>)", s)
            table = os.path.basename(loc.group(1)) if loc else "?"
            print(f"- scan `{table}`: pushed {pf.group(1) if pf else '[]'}; reads `{rs.group(1) if rs else '?'}`")
        print("\n```")
        print(graph.replace("== Physical Plan ==\n", "").rstrip())
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
