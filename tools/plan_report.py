"""Write PLANS.md: condensed physical plans of the headline queries
(operators, exchanges, joins, pushed filters), from ``explain`` output."""

import re
import sys

sys.path.insert(0, "/root/repo")

from conceptsearch.plans.catalog import QUERIES  # noqa: E402
from conceptsearch.session import build_session  # noqa: E402

NAMES = ["sae_encode_threshold", "build_inverted_index", "sparse_topk", "dense_search", "ndcg_at_k",
         "whole_word_mask", "running_mean", "rank_all", "index_save_load"]
KEEP = ("Exchange", "Join", "WindowGroupLimit", "Window", "HashAggregate", "MapInPandas",
        "ArrowEvalPython", "FlatMapGroupsInPandas", "Scan", "Subquery", "InMemoryTableScan", "Sort ")


def condensed(plan: str) -> list[str]:
    out = []
    for line in plan.split("\n"):
        if any(k in line for k in KEEP):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"\[plan_id=\d+\]", "", line)
            line = re.sub(r"Location: [^,]*, ", "", line)
            out.append(line.rstrip()[:200])
    return out


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    lines = ["# Physical plans of the headline queries", "",
             f"Generated by `tools/plan_report.py` on `{sf}` (local[8]); operator lines only.", ""]
    for name in NAMES:
        df = QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines += [f"## {name}", "", "```"] + condensed(plan) + ["```", ""]
    open("/root/repo/PLANS.md", "w").write("\n".join(lines))


if __name__ == "__main__":
    main()
