"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from twinvec.plans import catalogue

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = (
    "fused_topk_mixed_alpha", "fused_topk_fixed_alpha_grid", "knn_graph", "skyline_layer0", "pq_encode_fixed", "adc_topk_fixed", "pq_rerank",
    "recall_at_k", "delete_splice", "graph_build", "search_beam", "search_rerank", "dynamic_replay",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = dict(catalogue.queries())
    names = list(QUERIES)
    try:
        from twinvec.llm import queries as llm
    except ImportError:
        pass
    else:
        found |= llm.queries()
        names += list(llm.queries())
    took = {}
    for name in names:
        began = time.perf_counter()
        found[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    # The search itself: queries a second at the measured recall, beside the build.
    from pyspark.sql import functions as F

    from twinvec.operators import graph, knn, metrics, search
    from twinvec.plans import fixture

    points = fixture.points(spark, SF_DIR).select("id", "x", "y").cache()
    queries = fixture.queries(spark, SF_DIR)
    edges = graph.build_dual(points, 16, 40).cache()
    edges.count()
    truth = knn.exact_dual_knn(points, queries, 10).cache()
    quality = {}
    for pool in (20, 40, 100, 200):
        began = time.perf_counter()
        got = search.search(points, edges, queries, 10, pool).cache()
        got.count()
        seconds = time.perf_counter() - began
        recall = metrics.recall_at_k(got, truth, 10).agg(F.avg("recall")).first()[0]
        quality[f"L{pool}"] = {"recall_at_10": round(recall, 2), "sec": round(seconds, 3)}
    print(json.dumps({"metric": "total_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "search": quality, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
