"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "a3_size_histogram", "a8_directory_links", "f1_f2_exclude", "f3_first_match", "m1_m2_layer_merge", "m4_archive_override", "j5_link_targets",
    "j7_offsets", "j8_map_devices", "w5_islands", "x2_chunk_map", "x7_range_parts", "x6_x7_s10_read_ranges", "d1_unique_chunks", "d8_tail_groups",
    "d11_identical_files", "a11_shared_xattrs", "a12_shared_ids", "i3_w1_name_order", "i8_digest_status", "j13_compare_trees",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from canopy.plans.catalog import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # starts the executors
    took = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
