"""Whole jobs: operators wired to sources and sinks.

Order in every job: mappings reach the vault before the text that needs them is
published.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.operators.bodies import sanitize_requests
from veilmark.operators.detect import BatchDetector
from veilmark.operators.redact import extract_mappings, redact
from veilmark.operators.rehydrate import rehydrate
from veilmark.operators.vault import vault_put
from veilmark.options import Options
from veilmark.sources.tables import (
    stored,
    write_rejected,
    write_requests,
    write_vault,
)


def sanitize_job(
    requests: DataFrame,
    options: Options,
    vault_path: str,
    out_path: str,
    rejected_path: str | None = None,
    *,
    writer_id: str,
    batch_id: int,
    detector: BatchDetector | None = None,
    written_at: datetime | str | Column | None = None,
) -> None:
    """Sanitize a request table: vault first, then bodies, then rejected rows.

    The sanitized table is stored once and both outputs are written from it, so each
    body is parsed and inspected once, and the vault holds exactly the tokens of the
    bodies that go out, whatever a ``detector`` of your own would answer next time.

    ``writer_id`` and ``batch_id`` name this write: the same pair again replaces it.
    """
    done = stored(sanitize_requests(requests, options, detector=detector))
    write_vault(
        vault_put(extract_mappings(done), options.ttl_seconds, written_at),
        vault_path,
        writer_id,
        batch_id,
    )
    write_requests(done, out_path, writer_id, batch_id)
    if rejected_path and options.on_error == "closed":
        write_rejected(done, rejected_path, writer_id, batch_id)


def round_trip(
    df: DataFrame,
    options: Options,
    keys: str,
    text: str = "text",
    now: datetime | str | None = None,
) -> DataFrame:
    """Redact and restore: keys, original and restored text.

    ``restored`` equals ``original`` unless the input itself holds live tokens.
    The redacted table is stored first, as it would be in use.
    """
    redacted = stored(redact(df.select(keys, text), options, text))
    vault = vault_put(extract_mappings(redacted), options.ttl_seconds, now)
    back = rehydrate(redacted.select(keys, text), vault, keys, text, now)
    return (
        df.select(keys, F.col(text).alias("original"))
        .join(back.withColumnRenamed(text, "restored"), keys)
    )

