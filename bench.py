"""Headline queries, timed: one warm-up run, then the median of the rest.

Prints one JSON line.  ``BENCH_SF_DIR``, ``BENCH_CPUS``, ``BENCH_RUNS`` and
``BENCH_QUERIES`` (comma-separated names) change what is run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import REGISTRY  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = [
    # tabular
    "filter_count", "group_avg", "dim_join_agg", "direct_file_agg", "selective_group_avg",
    "csv_roundtrip_agg", "group_topk", "full_sort",
    # samples and rating
    "sample_medians", "rate_usage", "cost_matrix",
    # cache audit
    "ttl_replay", "leak_summary", "owner_runs", "leak_by_policy", "ttl_replay_stream",
    "client_runs", "run_stretches", "ttl_signature", "speedup_vs_baseline",
    # text and pages
    "term_counts", "text_clean", "markdown_converter", "region_text", "text_retention", "probe_eval", "probe_scores",
]


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", cpus=cpus)
    took = {}
    for name in names:
        def once():
            REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()

        once()
        took[name] = round(statistics.median(timed(once) for _ in range(runs)), 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    line = {"metric": "headline queries, total of medians", "value": round(sum(took.values()), 3), "unit": "sec",
            "queries": took, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf, "cpus": cpus}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
