"""Summarise the executed physical plans of the headline queries (writes PLANS.md).

Usage: python tools/plan_report.py [sf_dir]
Counts exchanges, join strategies, aggregates and windows in the final
(adaptive) plan and lists what each Parquet scan reads.
"""

from __future__ import annotations

import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NODES = ["Exchange", "BroadcastExchange", "ReusedExchange", "SortMergeJoin", "BroadcastHashJoin",
         "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "HashAggregate",
         "SortAggregate", "ObjectHashAggregate", "Window", "Expand", "FileScan"]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from bench import HEADLINE
    from shelfscan.plans import catalog
    from shelfscan.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    lines = ["# Physical plans of the headline queries", "",
             f"Final adaptive plans at `{sf_dir}` (generated by `tools/plan_report.py`). "
             "Shared inputs (prepared source, first rows, routed rows, survey fact) are staged as Parquet while "
             "the query is built; the scans of a query read the columns below of them. "
             "Small dimension sides become broadcast joins at run time (AQE); no cross or nested-loop join "
             "occurs.", "",
             "| query | " + " | ".join(NODES) + " |", "|---|" + "---|" * len(NODES)]
    scans, filters = {}, {}
    for name in HEADLINE:
        catalog.reset()
        df = catalog.QUERIES[name](spark, sf_dir)
        df.collect()  # execute this very DataFrame so its adaptive plan is final
        full = df._jdf.queryExecution().executedPlan().toString()
        # AdaptiveSparkPlan prints the final plan, then the initial one: keep the final part
        plan = full.split("== Initial Plan ==")[0]
        counts = collections.Counter()
        for node in NODES:
            counts[node] = len(re.findall(rf"(?<![A-Za-z]){node}(?![A-Za-z])", plan))
        lines.append(f"| {name} | " + " | ".join(str(counts[n]) for n in NODES) + " |")
        filters[name] = sorted(set(f for f in re.findall(r"(?:PushedFilters|PartitionFilters): (\[[^\n]+?\]), (?:ReadSchema|PushedFilters)", plan)))
        scans[name] = sorted(set(re.findall(r"ReadSchema: (struct<[^\n]*>)", plan)))
    lines += ["", "## Parquet columns read", ""]
    for name, sc in scans.items():
        lines.append(f"* **{name}**: " + ("; ".join(f"`{s}`" for s in sc) if sc else "none"))
        if filters[name]:
            lines.append("  * filters at the scan: " + "; ".join(f"`{f}`" for f in filters[name]))
    catalog.reset()
    spark.stop()
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    print("\n".join(lines))


if __name__ == "__main__":
    main()
