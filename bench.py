"""Benchmark the headline queries; prints ONE JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_RUNS`` (timed runs per query after one warm-up, default 2).
Each run materialises the whole result with the ``noop`` sink (no collect to
the driver); the reported time per query is the median of the timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "stat_features_all",
    "seq_full",
    "seq_visits",
    "text_interactions",
    "text_searches",
    "vec_merge_all",
    "als_urls",
    "next_item_unseen",
    "metrics_rank",
    "enc_bag_pca",
    "enc_text",
    "seq_negatives",
    "als_signed",
    "metrics_numeric",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = max(1, int(os.environ.get("BENCH_RUNS", "2")))
    from shoplens.plans.registry import entries
    from shoplens.session import build_session, drop_tables

    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus * 2)
    es = entries()
    names = [n for n in HEADLINE if n in es]
    times: dict[str, float] = {}
    for name in names:
        build = es[name].build
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()      # warm-up
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
        drop_tables(spark)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "runs": runs,
                      "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
