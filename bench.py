"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder of the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
BENCH_RUNS    timed runs per query after one warm-up (default 3, median taken)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

import registry.queries as registered  # noqa: E402
from registry.corpus import derived  # noqa: E402

HEADLINE = (
    "normalize_url", "parse_host", "feature_vector", "feat_brand_similarity", "blocklist_match", "domain_meta_enrich",
    "dedup_keep_first", "balance_classes", "build_training_corpus", "harvest_fresh_roots", "threshold_sweep",
    "equal_fp_operating_point", "prob_percentiles", "keyword_gate_sweep", "verdict_counts", "scan_log_verdicts",
    "scan_kpis", "daily_breakdown", "top_threats", "score_batch",
)
# Rows each throughput figure is over.
THROUGHPUT = {"verdict_counts": "fx_urls", "scan_log_verdicts": "fx_scan_log", "score_batch": "fx_urls", "feature_vector": "fx_urls"}


def run(name: str, spark: SparkSession, sf_dir: str) -> float:
    start = time.perf_counter()
    registered.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times, rates = {}, {}
    for name in HEADLINE:
        run(name, spark, sf_dir)
        times[name] = round(statistics.median(run(name, spark, sf_dir) for _ in range(runs)), 3)
        if name in THROUGHPUT:
            rates[name] = round(derived(spark, sf_dir, THROUGHPUT[name]).count() / times[name])
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows_per_sec": rates,
                "sf": Path(sf_dir).name,
            }
        )
    )


if __name__ == "__main__":
    main()
