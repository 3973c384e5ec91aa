"""Audit events and detection metrics, without any value.

An event says what kind of finding a request had, and names the value by its token only.
Metrics are counts and distinct sketches by time window and entity type; sketches of windows,
hours or regions merge into larger ones without reading events again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT_COLUMNS = ("event_id", "request_id", "ts", "entity_type", "token")
SKETCH_LOG_SIZE = 12  # 4,096 registers: a standard error of about 1.6 %


def detection_events(
    redacted: DataFrame, request_id: str = "request_id", ts: str = "ts", mappings: str = "mappings"
) -> DataFrame:
    """(event_id, request_id, ts, entity_type, token): one row per replaced span.

    ``event_id`` follows from the request and the span's place in it, so a request that is
    worked on again gives the same events.
    """
    name = F.col(request_id).cast("string")
    rows = redacted.select(
        name.alias("request_id"), F.col(ts).alias("ts"), F.posexplode_outer(mappings).alias("_pos", "_found")
    ).where(F.col("_found").isNotNull())
    return rows.select(
        F.concat_ws(":", F.coalesce("request_id", F.lit("")), "_pos").alias("event_id"),
        "request_id",
        "ts",
        "_found.entity_type",
        "_found.token",
    )


def detection_metrics(
    events: DataFrame, window: str = "1 hour", late_seconds: int = 600, log_size: int = SKETCH_LOG_SIZE
) -> DataFrame:
    """(window_start, window_end, entity_type, findings, tokens, requests) per window and type.

    ``findings`` is exact: an event delivered again counts once, in a stream as long as it
    comes within the watermark.  ``tokens`` and ``requests`` are mergeable sketches of the
    distinct ones.  A stream's window comes out when the watermark has passed it; events that
    are later than ``late_seconds`` are not counted.  Events without a time are left out.
    """
    events = events.where("ts is not null")
    if events.isStreaming:
        events = events.withWatermark("ts", f"{late_seconds} seconds")
        events = events.dropDuplicatesWithinWatermark(["event_id"])
    else:
        events = events.dropDuplicates(["event_id"])
    return (
        events.groupBy(F.window("ts", window).alias("_window"), "entity_type")
        .agg(
            F.count(F.lit(1)).alias("findings"),
            F.hll_sketch_agg("token", F.lit(log_size)).alias("tokens"),
            F.hll_sketch_agg("request_id", F.lit(log_size)).alias("requests"),
        )
        .select(
            F.col("_window.start").alias("window_start"),
            F.col("_window.end").alias("window_end"),
            "entity_type",
            "findings",
            "tokens",
            "requests",
        )
    )


def rollup_metrics(metrics: DataFrame, *keys: str) -> DataFrame:
    """(keys, findings, distinct_tokens, distinct_requests) over all windows of each key.

    Adds counts and merges sketches; a value that occurs in several windows counts once.
    """

    def distinct(column: str):
        return F.hll_sketch_estimate(F.hll_union_agg(column))

    return metrics.groupBy(*keys).agg(
        F.sum("findings").alias("findings"),
        distinct("tokens").alias("distinct_tokens"),
        distinct("requests").alias("distinct_requests"),
    )
