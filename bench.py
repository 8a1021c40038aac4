"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Every query is written to the noop sink, so all of its rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import time

from junctura.catalog import all_queries
from junctura.session import local_session

HEADLINES = (
    "reads_filter",
    "reads_funnel",
    "translate_trim",
    "unique_reads",
    "ngrams_frames",
    "vocab_counts",
    "seq_vectors_given_vocab",
    "sample_n_per_group",
    "fold_rows",
    "subject_mean_vector",
    "knn",
    "label_share",
    "feature_select",
    "feature_table",
    "cluster_feature_table",
    "composition",
    "mean_abs_diff_lines",
    "moran_parts",
    "pca_norm",
    "class_report_lines",
    "ml_naive_bayes",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    queries, times = all_queries(), {}
    queries["group_sizes"](spark, sf).write.format("noop").mode("overwrite").save()  # start the JVM's code paths
    for name in HEADLINES:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
