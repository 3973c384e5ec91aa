"""Headline timings: prints one JSON line.

Each query runs to a no-op sink over its whole tables: once to warm the JVM up,
then timed.  The line also has the rate of redaction over many copies of the documents,
where fixed costs do not count.  Environment: BENCH_SF_DIR (default sf0.1), BENCH_CPUS
(default 8), BENCH_COPIES (default 20, 0 for none).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from veilmark.operators.redact import redact  # noqa: E402
from veilmark.plans.queries import REGEX, queries  # noqa: E402

HEADLINES = [
    "detect_regex_documents",
    "detect_dictionary",
    "redact_documents",
    "redact_columns_pages",
    "extract_mappings",
    "vault_live",
    "detokenize",
    "rehydrate_documents",
    "round_trip_documents",
    "extract_texts",
    "sanitize_requests",
    "ingest_analyzer",
    "rechunk_batch",
    "rehydrate_chunks_batch",
    "detect_terms",
]


def redaction_rate(spark: SparkSession, sf_dir: str, copies: int, cpus: int) -> dict:
    """Rows and megabytes of text per second and core, over ``copies`` of each document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    many = documents.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    # copies differ, so that no part of the work can be shared
    many = many.select("doc_id", F.concat("text", F.lit(" "), "copy").alias("text"))
    many = many.repartition(4 * cpus)
    size = many.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    started = time.perf_counter()
    redact(many, REGEX).write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - started
    return {
        "rows_per_core_sec": round(size[0] / seconds / cpus, 1),
        "mb_per_core_sec": round((size[1] or 0) / 1e6 / seconds / cpus, 3),
        "copies": copies,
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    wanted = sys.argv[1:] or HEADLINES
    seconds = {}
    for name in wanted:
        for _ in range(2):
            started = time.perf_counter()
            frame = registered[name](spark, sf_dir)
            frame.write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
    copies = 0 if sys.argv[1:] else int(os.environ.get("BENCH_COPIES", "20"))
    rate = redaction_rate(spark, sf_dir, copies, int(cpus)) if copies else {}
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "redaction_rate": rate,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
