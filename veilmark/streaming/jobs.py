"""Streaming jobs: sanitize requests and restore responses as they arrive."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from veilmark.operators.chunks import rehydrate_blocks
from veilmark.operators.detect import BatchDetector
from veilmark.operators.outbound import only_rules, open_match_at, redact_parts
from veilmark.operators.redact import extract_mappings
from veilmark.operators.vault import vault_put
from veilmark.options import Options
from veilmark.plans.jobs import sanitize_job
from veilmark.sources.tables import read_vault, write_chunks, write_vault
from veilmark.streaming.rechunk import rechunk_stream


def _writer_of(batch: DataFrame, checkpoint: str) -> str:
    """The id Spark keeps in a query's checkpoint: a restart continues it, another
    checkpoint has another, so no two streams number the same batches."""
    metadata = batch.sparkSession.read.text(f"{checkpoint.rstrip('/')}/metadata")
    return json.loads(metadata.first()[0])["id"]


def sanitize_stream(
    requests: DataFrame,
    options: Options,
    vault_path: str,
    out_path: str,
    checkpoint: str,
    rejected_path: str | None = None,
    detector: BatchDetector | None = None,
) -> DataStreamWriter:
    """Writer to start: each micro-batch is one ``sanitize_job`` batch of the writer that
    the checkpoint names, so a replayed micro-batch replaces its own output only."""

    def run(batch: DataFrame, batch_id: int) -> None:
        sanitize_job(
            batch,
            options,
            vault_path,
            out_path,
            rejected_path,
            writer_id=_writer_of(batch, checkpoint),
            batch_id=batch_id,
            detector=detector,
        )

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def rehydrate_stream(
    chunks: DataFrame,
    vault_path: str,
    out_path: str,
    checkpoint: str,
    idle_seconds: int | None = 300,
    now: datetime | str | None = None,
    longest_ttl_seconds: int | None = None,
    late_path: str | None = None,
) -> DataStreamWriter:
    """Writer to start: re-cut live chunks, then restore them against the vault
    as it is at each micro-batch.  ``longest_ttl_seconds`` spares it the days whose
    tokens have all expired, see ``read_vault``.  Chunks that came after their stream was
    given up (``reason='late'``) are written with the others, or, as they came, to ``late_path``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        vault = read_vault(
            batch.sparkSession,
            vault_path,
            longest_ttl_seconds=longest_ttl_seconds,
            now=now,
        )
        # One computation of the stateful output serves all branches of the join.
        batch.persist()
        try:
            writer = _writer_of(batch, checkpoint)
            rows = batch
            if late_path is not None:
                write_chunks(batch.where("reason = 'late'"), late_path, writer, batch_id)
                rows = batch.where("reason <> 'late'")
            restored = rehydrate_blocks(rows, vault, ["stream_id", "seq"], now)
            write_chunks(restored, out_path, writer, batch_id)
        finally:
            batch.unpersist()

    return (
        rechunk_stream(chunks, idle_seconds)
        .writeStream.foreachBatch(run)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )


def redact_stream(
    chunks: DataFrame,
    options: Options,
    vault_path: str,
    out_path: str,
    checkpoint: str,
    idle_seconds: int | None = 300,
) -> DataStreamWriter:
    """Writer to start: find and replace personal data in live response streams.

    A stream's bytes wait until no rule can match across what follows, so what is found
    and written is what whole-text detection gives, for every way the stream was cut.
    Mappings go to the vault first; a replayed micro-batch replaces its own.
    """
    only_rules(options)

    def run(batch: DataFrame, batch_id: int) -> None:
        valid = F.is_valid_utf8(F.col("bytes").cast("string"))
        parts = batch.withColumnRenamed("chunk", "bytes").withColumn("valid", valid)
        parts = parts.withColumn("text", F.when(F.col("valid"), F.col("bytes").cast("string")))
        done = redact_parts(parts, options).persist()
        try:
            writer = _writer_of(batch, checkpoint)
            entries = vault_put(extract_mappings(done), options.ttl_seconds)
            write_vault(entries, vault_path, writer, batch_id)
            write_chunks(done.drop("mappings", "detect_error"), out_path, writer, batch_id)
        finally:
            done.unpersist()

    return (
        rechunk_stream(chunks, idle_seconds, open_at=open_match_at)
        .writeStream.foreachBatch(run)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
