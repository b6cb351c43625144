"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from candor.plans.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "text_scores",
    "text_features",
    "hashing_embeddings",
    "content_stats",
    "volume_spikes",
    "platform_intervals",
    "similar_vectors",
    "semantic_clusters",
    "temporal_campaigns",
    "cross_platform_campaigns",
    "word_overlap_top",
    "network_metrics",
    "image_texture",
    "image_repetition",
    "authenticity_classifier",
    "stream_hourly_volume",
    "all_campaigns",
)


def half_of_memory() -> int:
    total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30
    return int(max(2, min(14, total / 2)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", f"{half_of_memory()}g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="candor-"))
        .config("spark.sql.session.timeZone", "UTC")
        # one input file per table here: smaller splits let all cores read it
        .config("spark.sql.files.maxPartitionBytes", os.environ.get("BENCH_SPLIT", "4m"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["text_scores"](spark, sf_dir).limit(1000).write.format("noop").mode("overwrite").save()  # warm-up, not counted
    took = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(f"{name}: {took[name]}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
