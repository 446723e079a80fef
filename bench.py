"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "FIL06 FIL07 INV04 INV05 INV13 INV14 INV15 AGG03 AGG04 AGG05 AGG06 AGG08 AGG16 AGG20 WIN01 WIN03 WIN06 WIN08 WIN12 "
    "DEC01 DEC03 RSK03 FIN01 MKD06 MKD08 SCN01 SEN01 TSF07 TSF19 TSF21 TSF22 TSF23 TSF26 TSF29 SRC02 SRC13 SNK04 "
    "MAP07 STR01 STR01_stream STR06"
).split()


def main() -> None:
    from granary.plans import catalogue

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("granary-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = sys.argv[1:] or HEADLINE
    queries = catalogue.runnable()
    times: dict[str, float] = {}
    queries["FIL06"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    for key in chosen:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[key](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[key] = round(statistics.median(taken), 3)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    if not sys.argv[1:]:
        # Ingest: the sales feed as CSV text through the bulk load into Parquet.
        from granary.sources.ingest import bulk_sales, read_text_csv
        from granary.sources.testdata import Tables

        t = Tables(spark, folder)
        work = tempfile.mkdtemp(prefix="granary-bench-")
        t.raw_sales.write.csv(f"{work}/in", header=True)
        start = time.perf_counter()
        raw = read_text_csv(spark, f"{work}/in", t.raw_sales.columns)
        bulk_sales(raw, t.products).write.parquet(f"{work}/out")
        times["ingest_csv"] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
