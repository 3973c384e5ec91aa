"""Readers and writers for request, chunk and vault tables.

Any Spark source works; these fix schemas and layouts.  Writes are per writer and
batch: writing the same batch of the same writer again replaces that batch and
nothing else, so a retried job or micro-batch leaves no duplicates, and two writers
that share a table never replace each other's rows.
"""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from veilmark.operators.vault import VAULT_SCHEMA, as_timestamp

REQUEST_SCHEMA = "body_id bigint, body string"
CHUNK_SCHEMA = "stream_id bigint, seq bigint, chunk binary, eos boolean, ts timestamp"
COMPACTED = "-compacted-"
LAYOUT = ["writer_id", "batch_id"]
VAULT_LAYOUT = ["written_day", *LAYOUT]
VAULT_TABLE_SCHEMA = f"{VAULT_SCHEMA}, written_day date, writer_id string, batch_id bigint"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table that arrives in fewer partitions than there are cores.

    Detection is bound by CPU, and a small file with one row group would run on
    one core.  A table that is large enough to matter has more splits than the
    cluster has cores and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def new_folder(spark: SparkSession) -> str:
    """Path of a new folder below the shared one named by ``spark.checkpoint.dir``.

    Only a session that runs in one process (tests) may leave that unset; a
    temporary folder is made for it.  On a cluster executors would each write to
    their own disk, so there it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        return tempfile.mkdtemp(prefix="run-")
    return f"{shared.rstrip('/')}/run-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to a new shared folder and read it back.

    For results that several branches of one plan use: they are computed once,
    later stages read only the columns they need, and a lost executor costs a
    re-read, not a re-computation.  The folder is left to the cluster's cleanup.
    """
    path = f"{new_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_requests(
    spark: SparkSession,
    path: str | list[str],
    format: str = "parquet",
    schema: str = REQUEST_SCHEMA,
    **options: str,
) -> DataFrame:
    """Request bodies, one per row.

    ``format='text'`` reads one body per line (``wholetext='true'`` in options:
    one per file); the id is then the file name and the start of the body's digest, so
    only equal bodies of one file share an id.
    """
    if format == "text":
        digest = F.substring(F.sha2(F.col("value").cast("binary"), 256), 1, 16)
        name = F.concat_ws("#", F.input_file_name(), digest)
        lines = spark.read.format("text").options(**options).load(path)
        return lines.select(name.alias("body_id"), F.col("value").alias("body"))
    return spark.read.schema(schema).format(format).options(**options).load(path)


def stream_requests(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    schema: str = REQUEST_SCHEMA,
    **options: str,
) -> DataFrame:
    """Request bodies as they arrive."""
    return spark.readStream.schema(schema).format(format).options(**options).load(path)


def read_chunks(
    spark: SparkSession,
    path: str | list[str],
    format: str = "parquet",
    schema: str = CHUNK_SCHEMA,
    **options: str,
) -> DataFrame:
    """Chunk table of finished streams."""
    return spark.read.schema(schema).format(format).options(**options).load(path)


def stream_chunks(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    schema: str = CHUNK_SCHEMA,
    **options: str,
) -> DataFrame:
    """Chunks as they arrive.  Bound a micro-batch with the source's own options
    (``maxFilesPerTrigger``, ``maxBytesPerTrigger``)."""
    return spark.readStream.schema(schema).format(format).options(**options).load(path)


def kafka_chunks(spark: SparkSession, **options: str) -> DataFrame:
    """Chunks from Kafka: key is the stream id, value the bytes, headers carry
    ``seq`` and ``eos``.  Needs the Kafka source package on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .options(**options)
        .option("includeHeaders", "true")
        .load()
    )
    headers = F.map_from_entries(
        F.transform(
            "headers",
            lambda h: F.struct(h["key"], F.decode(h["value"], "UTF-8").alias("value")),
        )
    )
    return raw.select(
        F.col("key").cast("string").cast("bigint").alias("stream_id"),
        headers["seq"].cast("bigint").alias("seq"),
        F.col("value").alias("chunk"),
        F.coalesce(headers["eos"].cast("boolean"), F.lit(False)).alias("eos"),
        F.col("timestamp").alias("ts"),
    )


def _batch_writer(
    df: DataFrame,
    writer_id: str,
    batch_id: int,
    format: str,
    layout: list[str] = LAYOUT,
) -> DataFrameWriter:
    if not writer_id:
        raise ValueError("a writer id is needed: who else may write to this table?")
    return (
        df.withColumns(
            {"writer_id": F.lit(writer_id), "batch_id": F.lit(batch_id).cast("bigint")}
        )
        .write.format(format)
        .partitionBy(*layout)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
    )


def write_requests(
    df: DataFrame, path: str, writer_id: str, batch_id: int, format: str = "parquet"
) -> None:
    """Rewritten bodies that may go on: rejected rows are left out."""
    if "status" in df.columns:
        df = df.where(F.col("status") != "rejected")
    kept = df.drop("mappings", "detect_error")
    _batch_writer(kept, writer_id, batch_id, format).save(path)


def write_rejected(
    df: DataFrame, path: str, writer_id: str, batch_id: int, format: str = "parquet"
) -> None:
    """Quarantine: ids and errors of rejected rows, no body."""
    rejected = df.where(F.col("status") == "rejected").drop("mappings", "body")
    _batch_writer(rejected, writer_id, batch_id, format).save(path)


def write_chunks(
    df: DataFrame, path: str, writer_id: str, batch_id: int, format: str = "parquet"
) -> None:
    _batch_writer(df, writer_id, batch_id, format).save(path)


def read_vault(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    longest_ttl_seconds: int | None = None,
    now: datetime | str | Column | None = None,
) -> DataFrame:
    """Vault rows; pass to ``vault_live`` and the operators that use it.

    With ``longest_ttl_seconds``, the longest life that any writer of this vault gives
    a token, only the days are listed and read whose rows can still be live at
    ``now``.  Older rows can neither live nor hide a live row, so the answer is the
    same.  (A day more is read, for writers in other time zones.)
    """
    rows = spark.read.schema(VAULT_TABLE_SCHEMA).format(format).load(path)
    if longest_ttl_seconds is not None:
        ago = F.make_dt_interval(secs=F.lit(longest_ttl_seconds))
        first = F.date_sub(F.to_date(as_timestamp(now) - ago), 1)
        rows = rows.where(F.col("written_day") >= first)
    return rows.drop(*VAULT_LAYOUT)


def write_vault(
    entries: DataFrame, path: str, writer_id: str, batch_id: int, format: str = "parquet"
) -> None:
    """Append vault rows as batch ``batch_id`` of ``writer_id``, replacing that batch if
    present.  The rows lie by day of writing.  Written again with other times, a batch
    leaves its old rows in their days: repeats of the same mappings, which do no harm.
    Jobs that share a vault need writer ids of their own, or one lineage of
    batch ids between them."""
    entries = entries.withColumn("written_day", F.to_date("written_at"))
    _batch_writer(entries, writer_id, batch_id, format, VAULT_LAYOUT).save(path)


def compact_vault(
    spark: SparkSession, path: str, new_path: str, now=None, format: str = "parquet"
) -> None:
    """Write the purged vault as a new version; readers switch to ``new_path``.

    A retry replaces the unfinished new version.  The old one is left in place.  The
    rows belong to a writer id that no job may use, so later batches never touch them.
    """
    from veilmark.operators.vault import vault_purge

    purged = vault_purge(read_vault(spark, path, format), now)
    write_vault(purged, new_path, COMPACTED, 0, format)
