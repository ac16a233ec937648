"""Audit the physical plans of the registered batch queries.

For each query: shuffles, broadcasts, windows, sorts, Python nodes, and
forbidden nodes (cross joins, row-at-a-time Python UDFs).  Prints a
markdown table.  Usage: python tools/plan_audit.py [sf_dir] [--big]

``--big`` disables the small-input shortcut, so the plans are the ones a
large input gets (range-partitioned scans and folds).  Node lines are
counted once each, so a cached subtree printed at every reference counts
once (it runs once).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
STREAM = "stream_"


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def audit(df) -> dict:
    t = plan_text(df)
    # a cached subtree is printed once per reference with the same expression
    # ids: count distinct node lines so each physical node counts once
    lines = {re.sub(r"^[\s:+\-*()0-9]*", "", ln) for ln in t.split("\n")}

    def n(pat):
        return sum(1 for ln in lines if re.search(pat, ln))

    return {
        "shuffles": n(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition"),
        "range": n(r"Exchange rangepartitioning"),
        "broadcasts": n(r"BroadcastExchange"),
        "windows": n(r"\bWindow "),
        "python": n(r"MapInPandas|ArrowEvalPython|FlatMapGroupsInPandas|TransformWithState"),
        "forbidden": [f for f in FORBIDDEN if f in t],
        "pushed": "PushedFilters: [In(event_type" in t or "PushedFilters" in t,
    }


def main() -> None:
    from keyfold.session import local_session

    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf = args[0] if args else "/root/testdata/sf0.1"
    spark = local_session(8)
    from keyfold.plans.catalogue import QUERIES

    print("| query | shuffles (range) | broadcasts | windows | python nodes | forbidden |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name, q in QUERIES.items():
        if name.startswith(STREAM):
            continue
        a = audit(q(spark, sf))
        print(f"| {name} | {a['shuffles']} ({a['range']}) | {a['broadcasts']} | {a['windows']} | {a['python']} | "
              f"{', '.join(a['forbidden']) or '-'} |")


if __name__ == "__main__":
    main()
