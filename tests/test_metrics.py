"""Detection metrics: exact counts, bounded sketch errors, no values."""

from pyspark.sql import functions as F

from veilmark.operators.redact import redact
from veilmark.options import Options
from veilmark.streaming.metrics import (
    EVENT_COLUMNS,
    detection_events,
    detection_metrics,
    rollup_metrics,
)


def test_events_hold_no_value(spark):
    rows = [(1, "2026-01-01 00:00:00", "mail a@b.com and 1.2.3.4"), (None, None, "c@d.com"), (2, "2026-01-01 00:00:00", None)]
    asked = spark.createDataFrame(rows, "request_id int, ts string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    events = detection_events(redact(asked, Options(salt="s", backend="regex")))
    assert tuple(events.columns) == EVENT_COLUMNS
    found = events.collect()
    assert sorted((r.event_id, r.entity_type) for r in found) == [
        ("1:0", "EMAIL_ADDRESS"), ("1:1", "IP_ADDRESS"), (":0", "EMAIL_ADDRESS")]
    metrics = detection_metrics(events.unionByName(events))
    for row in found + metrics.collect():
        assert not any(v in str(row) for v in ("a@b.com", "1.2.3.4", "c@d.com"))
    assert metrics.agg(F.sum("findings")).first()[0] == 2  # no time, no window


def test_sketches_merge_within_their_error(spark):
    events = spark.range(200_000).select(
        F.col("id").cast("string").alias("event_id"),
        (F.col("id") % 5000).cast("string").alias("request_id"),
        F.timestamp_seconds(F.col("id")).alias("ts"),
        F.lit("A").alias("entity_type"),
        F.concat(F.lit("t"), F.col("id") % 60_000).alias("token"),
    )
    metrics = detection_metrics(events)
    assert metrics.count() == 56
    row = rollup_metrics(metrics, "entity_type").first()
    assert row.findings == 200_000
    assert abs(row.distinct_tokens - 60_000) < 0.06 * 60_000
    assert abs(row.distinct_requests - 5000) < 0.06 * 5000


def test_no_events(spark):
    empty = spark.createDataFrame([], "event_id string, request_id string, ts timestamp, entity_type string, token string")
    assert detection_metrics(empty).count() == 0 and rollup_metrics(detection_metrics(empty), "entity_type").count() == 0
