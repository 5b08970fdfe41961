"""Times the headline queries on one machine and prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of cores. Every query runs to
its last row (a no-op sink); nothing is kept from one query to the next.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from markspark.plans.queries import QUERIES
from markspark.storage import remove_intermediate

HEADLINES = (
    "keep_document",
    "usable",
    "src_line_chunks",
    "char_counts",
    "form_counts",
    "fit_dictionary",
    "restore_frequent",
    "src_lines",
    "metrics_summary",
    "still_wrong",
    "windows_train",
    "windows_plan",
    "encode_example",
    "split_long_text",
    "restore_grouped",
    "train_context",
    "restore_context",
    "threshold_sweep",
    "score_windows",
    "vector_quantize",
    "sink_windows",
    "stream_filter",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("markspark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))  # one machine
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chars = documents.selectExpr("sum(length(text)) AS n").first().n

    # the first query of a session pays for starting the JVM's compiler and the Python workers
    QUERIES["restore_frequent"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        remove_intermediate(spark)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "chars": chars,
                "restored_lines_chars_per_sec": round(chars / seconds["src_lines"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
