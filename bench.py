"""Prints one JSON line: seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS], each the median of three warm runs."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from palimpsest.functions import checksums
from palimpsest.plans.queries import QUERIES
from palimpsest.sources import formats

HEADLINE = ("latest", "asof_txid", "asof_ts", "page_map", "compact_l1_1h", "txid_span", "plan_restore", "snapshot_retention", "l0_retention", "rolling_xor", "equivocation", "newest_first", "merge_shrunk")


def timed(f) -> float:
    took = []
    for k in range(4):
        t = time.perf_counter()
        f()
        took.append(time.perf_counter() - t)
    return statistics.median(took[1:])


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {q: round(timed(lambda q=q: QUERIES[q](spark, sf_dir).write.format("noop").mode("overwrite").save()), 4) for q in HEADLINE}
    image = os.urandom(4096) * 2048
    took["snapshot_encode_8mb"] = round(timed(lambda: formats.write_snapshot(image, 4096, 1, 0)), 4)
    data = formats.write_snapshot(image, 4096, 1, 0)
    took["snapshot_decode_8mb"] = round(timed(lambda: formats.read_snapshot(data)), 4)
    took["crc64_8mb"] = round(timed(lambda: checksums.crc64(image)), 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
