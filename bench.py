"""Times the headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS choose input and threads."""

from __future__ import annotations

import json
import os
import re
import sys
import threading
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")
HERE = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = f"{HERE}:{os.environ.get('PYTHONPATH', '')}"
sys.path.insert(0, HERE)

QUERIES = [
    "scan_classify",
    "luminance_ahash",
    "hamming_pairs_all",
    "hamming_pairs_top",
    "head_tail_pairs",
    "duration_bands",
    "constellation",
    "peak_need",
    "dup_components",
    "select_small_file",
    "delete_plan",
    "cache_lookup_miss",
    "audio_pairs",
]
#: Seconds after which a query is given up; it is named in the output then, and has no time.
LIMIT = 1200


def main() -> None:
    from pyspark.sql import SparkSession

    from twinscan.plans import catalog

    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("twinscan-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(2 * cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["duration_bands"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the session
    took: dict[str, float] = {}
    given_up: list[str] = []
    for name in QUERIES:
        began = time.time()
        stop = threading.Timer(LIMIT, spark.sparkContext.cancelAllJobs)
        stop.start()
        try:
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception:
            if time.time() - began < LIMIT:
                raise
            given_up.append(name)
            continue
        finally:
            stop.cancel()
        took[name] = round(time.time() - began, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(found[1]) if found else None} | ({"given_up": given_up} if given_up else {})))


if __name__ == "__main__":
    main()
