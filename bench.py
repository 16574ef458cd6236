"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

``store_build`` is the one-time cost of numbering samples, cutting windows and writing graph edges and
manifests; the queries after it read that store, as jobs on a real store would. Each query is run once
to completion into a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import time

QUERIES = [
    "sig01_time_stats", "sig04_band_power", "sig08_higuchi", "sig12_bandpass_recording", "qc05_subject_quality",
    "con01_pearson", "con03_coherence", "con04_wpli",
    "gra03_topk_per_node", "gra04_maximum_spanning_tree", "gra11_graph_bank", "gra12_fuse_vote_mean", "gra16_node_theory", "gra22_hypergraph_scores",
    "qc06_robust_zscore", "qc09_noise_scores", "qc21_cluster_balanced", "qc23_weighted_sample", "qc17_weight_summary",
    "clu06_cluster_summary", "clu09_pair_distances", "clu10_knn_purity",
    "eva01_soft_vote", "eva11_roc_auc", "eva17_metric_bundle", "eva20_error_analysis",
    "sta04_connectivity_summary", "sta08_edge_anova", "sta10_kruskal", "src10_parse_logs",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from waveloom.plans import catalog
    from waveloom.plans.views import Tables

    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH")]))  # for the workers
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("waveloom-bench")
             .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8").config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()  # start the engine before timing

    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)

    t = Tables(spark, sf_dir)
    timed("store_build", lambda: [t.samples, t.windows, t.edges, t.manifest])
    for q in QUERIES:
        timed(q, lambda q=q: catalog.run(q, spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
