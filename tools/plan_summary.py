"""Condensed executed-plan tree of registered queries (after AQE).

Usage: python tools/plan_summary.py SF_DIR name [name ...]
Prints one line per physical operator (code-generation wrappers and
adapters omitted) with the join strategy, exchange kind, output rows.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SKIP = {"WholeStageCodegen", "InputAdapter", "ColumnarToRow", "AdaptiveSparkPlan", "Project",
        "ResultQueryStage", "ShuffleQueryStage", "BroadcastQueryStage", "AQEShuffleRead"}


def _rows(node):
    it = node.metrics().iterator()
    while it.hasNext():
        kv = it.next()
        if kv._1() == "numOutputRows":
            return kv._2().value()
    return None


def walk(node, depth, out):
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return walk(node.executedPlan(), depth, out)
    if name in ("ResultQueryStage", "ShuffleQueryStage", "BroadcastQueryStage"):
        return walk(node.plan(), depth, out)
    nxt = depth
    if not any(name.startswith(s) for s in SKIP):
        full = node.simpleString(200)
        label = full[:90] if name == "Exchange" else full.split(" [")[0]
        if name.startswith("Scan") or name.startswith("FileScan"):
            label = "Scan " + node.simpleString(400).split("Location")[0].split("[")[0].strip()
        rows = _rows(node)
        line = "  " * depth + label
        line = line if len(line) <= 120 else line[:117] + "..."
        out.append(line + (f"  rows={rows}" if rows is not None else ""))
        nxt = depth + 1
    ch = node.children()
    for i in range(ch.size()):
        walk(ch.apply(i), nxt, out)


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:]
    from spindex import get_spark
    from spindex.catalog import registry
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    for name in names:
        df = registry()[name](spark, sf_dir)
        df.collect()
        out = []
        walk(df._jdf.queryExecution().executedPlan(), 0, out)
        print(f"### {name}\n```\n" + "\n".join(out) + "\n```\n")


if __name__ == "__main__":
    main()
