"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: median of two runs (BENCH_RUNS) after a warm-up, results written to Spark's noop sink."""

from __future__ import annotations

import importlib
import json
import os
import statistics
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "flagship", "gopher_quality", "gopher_repetition_full", "fineweb_quality", "c4_quality", "exact_dedup", "minhash_dedup", "decont_filter", "pii_mask", "extract_text", "tokenize_lengths",
    "op1_quality_rules", "op2_language_id", "op3_token_files", "op4_packing", "op5_chat_formatting", "op6_license_scan", "op7_pii", "op8_line_dedup", "op9_minhash_neardup", "op10_decontamination", "pipeline",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    names, runs = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","), int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "2m").config("spark.sql.files.openCostInBytes", "64k").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, times = importlib.import_module("__spark_entry__").queries(), {}
    for name in (n for n in names if n in found):
        taken = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({"metric": "total seconds of headline queries, median of warm runs", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
