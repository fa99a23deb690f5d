"""Time the headline queries: full result into a no-op sink, median of warm runs, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarrylight.catalog import load_all  # noqa: E402
from quarrylight.catalog.registry import QUERIES  # noqa: E402
from quarrylight.session import build_session  # noqa: E402

HEADLINE = [
    "bm25_index_terms",
    "bm25_search_topk",
    "dense_hashed_topk",
    "knn_topk",
    "rrf_fusion",
    "hybrid_retrieval",
    "retrieval_metrics",
    "boost_scores",
    "template_answer",
    "hallucination_heuristic",
    "graph_edges",
    "graph_neighbors_1hop",
    "rolling_percentiles",
    "histogram_quantile_5m",
    "rate_sliding",
    "merge_full_outer",
    "chunk_documents",
]


def run_once(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        runs = [run_once(spark, name, folder) for _ in range(repeats + 1)]
        seconds[name] = round(statistics.median(runs[1:] or runs), 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
