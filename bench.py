"""Benchmark the headline queries on one scale factor.

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is forced with the ``noop`` sink (full evaluation, no collect).
Before timing, every headline query runs once on the tiny sf0.001 tables
(other files, so no result can be reused): that compiles the plan shapes
and starts the Python workers, as a long-running session would have.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conceptsearch.plans.catalog import QUERIES  # noqa: E402
from conceptsearch.session import build_session  # noqa: E402

HEADLINE = [
    "sae_encode_threshold",
    "build_inverted_index",
    "sparse_topk",
    "dense_search",
    "ndcg_at_k",
    "macro_average",
    "sae_reconstruct",
    "train_records",
    "prompt_text",
    "whole_word_mask",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "conceptsearch-bench", shuffle_partitions=int(cpus),
                          extra_conf={"spark.driver.memory": "16g"})
    names = [n for n in HEADLINE if n in QUERIES]
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    for name in names:
        if os.path.isdir(warm_dir):
            QUERIES[name](spark, warm_dir).write.mode("overwrite").format("noop").save()
    timings = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.mode("overwrite").format("noop").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
