"""Time the headline queries and print one JSON line.

$BENCH_SF_DIR (default /root/testdata/sf0.1), $BENCH_CPUS (default 8), $BENCH_QUERIES (names).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from molq import build_session
from molq.suite import load_all

HEADLINE = (
    "method_scorecard cell_gene_counts derived_cells cell_qc_summary assignment_pre_post "
    "pruning_summary windows_range_join density_grid extracted_windows pair_cooccurrence npmi_panel "
    "document_word_npmi counting_coherence relu_coherence coherence_summary pearson_coexpression "
    "spearman_coexpression pseudobulk_mean_log reference_consistency rank_correlations ranked_genes "
    "marker_specificity_log2 label_transfer embedding_knn_graph spatial_knn_graph mutual_nearest "
    "mann_whitney penalized_ranking mixture_entropy stream_density_grid").split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    spark = build_session(f"local[{cpus}]", "molq-bench", int(cpus), **{"spark.driver.memory": "20g"})
    suite = load_all()
    # One small query starts the JVM code paths and the Python workers before the clock runs.
    suite["pair_cooccurrence"].run(spark, re.sub(r"sf[\d.]+$", "sf0.001", sf_dir.rstrip("/"))).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        suite[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(found.group(1)) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
