"""Headline queries, timed: one JSON line on stdout. BENCH_SF_DIR and BENCH_CPUS set data and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from anamnesis.session import local_session  # noqa: E402
from workload import all_entries  # noqa: E402

HEADLINE = (
    "knn_join", "knn_join_filtered", "ann_join_ivf", "bm25_join", "index_build", "bm25_from_postings", "rrf_fuse",
    "recall_semantic", "recall_hybrid", "recall_hybrid_indexed", "recall_hybrid_filtered", "list_ranked", "search_summary", "search_trigram", "search_regex",
    "chunk_text", "tokenize", "embed_column", "build_postings", "refresh_indexes", "conversation_entries", "tag_counts",
    "snapshot_diff", "apply_updates", "ingest", "near_duplicate_store", "near_duplicate_join", "retrieval_eval",
    "envelope_round_trip", "nearest_rank_percentile",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores), app="bench")
    entries = all_entries()
    # One small query first, so that JVM and worker start-up are not charged to the first headline.
    entries["bm25_join"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
