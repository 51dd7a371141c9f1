"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ripplet.plans import registry  # noqa: E402
from ripplet.session import local_session  # noqa: E402

HEADLINE = [
    "edge_ids", "graph_node_counts", "node_upsert", "edge_upsert", "detach_delete", "sync_receipt", "edge_dedupe_first",
    "unique_call_target", "paths_depth1", "paths_depth2", "paths_depth3", "paths_from_hubs", "impact_scores",
    "evidence_text", "seed_merge", "lexical_search", "task_tokens", "token_estimate", "diff_hunks", "diff_seeds",
    "smallest_enclosing", "greedy_pack", "rate_limit_guard", "recall_precision_at_k", "code_edges",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores, os.environ.get("BENCH_MEMORY", "12g"))
    registry.load_all()
    spark.read.parquet(os.path.join(folder, "region.parquet")).count()
    times = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
