"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cdrloom.plans import load_catalog
from cdrloom.session import local_session

HEADLINE = [
    "class_property_summary", "annotate_liabilities", "ensure_cdr3", "kmer_frequencies", "cdr3_mutants", "threshold_sweep",
    "curve_areas", "spearman", "correlation_matrix_pearson", "position_entropy", "enrichment_labels", "consolidate_clusters",
    "position_stats", "threshold_report", "box_stats", "score_kde", "group_stratified_folds", "similarity_join", "max_blosum_similarity",
    "greedy_cluster",
]
WARM = "/root/testdata/sf0.001"


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("cdrloom-bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_catalog().QUERIES
    for name in HEADLINE:  # one pass over the smallest tables, so that no query carries the start-up
        queries[name](spark, WARM).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
