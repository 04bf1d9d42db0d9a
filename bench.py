"""Headline queries: prints one JSON line with the seconds per query.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8).
Every query runs in a fresh context, so saved intermediate tables are part of
its time.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "s1_corpus_scan", "t6_marker_summary", "t7_most_marked_files", "d1_section_split", "d13_multi_source_merge", "c7_claim_summary",
    "r1_evidence_per_file", "x1_claim_evidence_match", "i5_crud_completeness", "f14_ecosystem_dispatch", "e7_segment_statistics",
    "h1_edge_inference", "m1_component_table", "m16_tasks", "q8_cross_repository_run", "v1_batch_packing", "a3_file_churn", "o3_phase_bottlenecks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from repograin.plans import catalog  # noqa: F401
    from repograin.plans.base import QUERIES, Context
    from repograin.plans.flagship import urgent_files_by_topic
    from repograin.session import local_session

    spark = local_session(cpus, max(int(cpus), 8))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    jobs = [("flagship", urgent_files_by_topic)] + [(n, QUERIES[n]) for n in HEADLINE]
    for name, fn in jobs:
        start = time.time()
        fn(Context(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
