"""Run every registered operator on silver tables and summarise its final plan.

    python scripts/plan_report.py [sf_dir] > PLANS.md

For each key: Parquet scans, shuffle exchanges (hash / range / single), broadcast
exchanges, join strategies, windows, scalar subqueries, sort vs hash aggregates
and Python evaluation nodes - read from the executed AQE plan.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.plans.queries import OPERATORS, SilverTables  # noqa: E402
from ledgerlens.session import local_session, scratch_path  # noqa: E402

PATTERNS = {
    "scans": r"Scan parquet",
    "hash shuffles": r"Exchange hashpartitioning",
    "range shuffles": r"Exchange rangepartitioning",
    "single-partition": r"Exchange SinglePartition",
    "broadcasts": r"BroadcastExchange",
    "BHJ": r"BroadcastHashJoin",
    "SMJ": r"SortMergeJoin",
    "windows": r"\bWindow\b",
    "subqueries": r"Subquery subquery#(\d+)",
    "sort aggs": r"SortAggregate",
    "python": r"(BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas)",
}


def final_plan(df) -> str:
    df.collect()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    # keep the final plans only: drop every "== Initial Plan ==" block (the
    # lines indented deeper than its marker), including those of subqueries
    kept, skip_at = [], None
    for line in buf.getvalue().splitlines():
        indent = len(line) - len(line.lstrip(" :|+-"))
        if skip_at is not None:
            if indent > skip_at:
                continue
            skip_at = None
        if "== Initial Plan ==" in line:
            skip_at = len(line) - len(line.lstrip(" :|"))   # column of the marker's "+-"
            continue
        kept.append(line)
    return "\n".join(kept)


def table(spark, silver) -> None:
    cols = list(PATTERNS)
    print("| key | " + " | ".join(cols) + " |")
    print("| --- |" + " --- |" * len(cols))
    for key, op in OPERATORS.items():
        plan = final_plan(op(silver))
        counts = [str(len(set(re.findall(PATTERNS[c], plan))) if c == "subqueries"
                      else len(re.findall(PATTERNS[c], plan))) for c in cols]
        print(f"| `{key}` | " + " | ".join(counts) + " |")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    silver = SilverTables.build(spark, sf_dir, scratch_path(spark, f"plan-report-{uuid.uuid4().hex}"))
    print(f"# Final physical plans of the registered operators\n\nInput: silver tables derived from "
          f"`{sf_dir}`; AQE final plans (`scripts/plan_report.py`).\n")
    print("## As run (AQE may broadcast sides it measures small)\n")
    table(spark, silver)
    # the large-input case: no side is small enough to broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    print("\n## Large-input plans (broadcast thresholds off, as when every side is big)\n")
    table(spark, silver)
    spark.stop()


if __name__ == "__main__":
    main()
