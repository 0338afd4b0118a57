"""Headline queries, timed once warm: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from nodeflow.queries import load  # noqa: E402
from nodeflow.session import local_session  # noqa: E402

HEADLINE = (
    "route_batch", "vec_topk", "node_stats", "node_adjacency", "similarity_histogram", "fusion_candidates",
    "fusion_matching", "fusion_apply", "leader_cluster", "best_parent", "progressive_adoption", "process_batch",
    "full_run", "training_metadata", "training_order", "feedback_apply", "training_outcomes", "quarantine_counts",
    "lineage_history", "resolve_texts", "provenance_counts", "pointer_insert", "json_text_extract", "src_text_normalize",
    "perplexity_rollup", "eval_summary", "latest_metrics", "stream_node_stats", "stream_dedupe", "training_plan",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "nodeflow-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    queries["route_batch"](spark, sf_dir).count()  # start the workers
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    spark.stop()
    print(json.dumps({
        "metric": "total wall-clock of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1],
        "ingest_and_fusion_embeddings_per_sec": round(vectors / times["full_run"], 1), "cpus": cpus}))


if __name__ == "__main__":
    main()
