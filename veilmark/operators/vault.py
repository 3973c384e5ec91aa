"""The vault: token -> value, with expiry, as a table.

Writes only append.  A token written again gets a new row, and the read view
takes the newest row per token, so no update in place is ever needed and a
repeated write is harmless.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.fixed import DEFAULT_TTL_SECONDS
from veilmark.operators.lookup import HOT_ROWS, key_counts, lookup

VAULT_SCHEMA = (
    "token string, value string, entity_type string, "
    "written_at timestamp, expires_at timestamp"
)


def as_timestamp(moment: datetime | str | Column | None) -> Column:
    if moment is None:
        return F.current_timestamp()
    if isinstance(moment, Column):
        return moment
    return F.lit(moment).cast("timestamp")


def vault_put(
    mappings: DataFrame,
    ttl_seconds: int = DEFAULT_TTL_SECONDS,
    written_at: datetime | str | Column | None = None,
) -> DataFrame:
    """Mappings to vault rows that live for ``ttl_seconds`` from the write."""
    if ttl_seconds <= 0:
        raise ValueError("ttl_seconds must be positive")
    written = as_timestamp(written_at)
    return mappings.select(
        "token",
        "value",
        "entity_type",
        written.alias("written_at"),
        (written + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"),
    )


def vault_live(
    vault: DataFrame,
    now: datetime | str | Column | None = None,
    tokens: DataFrame | None = None,
) -> DataFrame:
    """Newest row per token, unless it has expired.

    With ``tokens`` (column ``token``) only those are kept, before anything is
    grouped: a small batch then never shuffles a large vault, and a large batch
    shuffles it by the same key the grouping needs anyway.

    A row is live while now <= expires_at.  The newest write decides, also when
    it gave the token a shorter life than an older write did, so expiry is
    tested after the choice.  Repeats of a hot token are merged inside each task
    before the shuffle.
    """
    if tokens is not None:
        vault = vault.join(tokens, "token", "left_semi")
    newest = F.max(F.struct("written_at", "expires_at", "value", "entity_type"))
    return (
        vault.groupBy("token")
        .agg(newest.alias("_newest"))
        .select(
            "token",
            "_newest.value",
            "_newest.entity_type",
            "_newest.written_at",
            "_newest.expires_at",
        )
        .where(F.col("expires_at") >= as_timestamp(now))
    )


def vault_get(
    tokens: DataFrame,
    vault: DataFrame,
    token: str = "token",
    now: datetime | str | Column | None = None,
) -> DataFrame:
    """Add ``value`` for each token; null when unknown or expired."""
    return resolve(tokens, token, vault, "value", now)


def detokenize(
    df: DataFrame,
    vault: DataFrame,
    column: str,
    now: datetime | str | Column | None = None,
) -> DataFrame:
    """Replace a column of tokens by their values; others stay as they are."""
    found = resolve(df, column, vault, "_value", now)
    return found.withColumn(column, F.coalesce("_value", column)).drop("_value")


def resolve(
    df: DataFrame,
    column: str,
    vault: DataFrame,
    value: str,
    now: datetime | str | Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the live value of each token in ``column`` as column ``value``."""
    counts = key_counts(df.select(F.col(column).alias("_key")), "_key")
    # the test on the count keeps this plan equal to the one that finds hot
    # keys, so Spark computes the counts once
    needed = counts.where(F.col("count") > 0).select(F.col("_key").alias("token"))
    table = vault_live(vault, now, needed).select(
        F.col("token").alias("_vault_token"), F.col("value").alias(value)
    )
    counts = counts.withColumnRenamed("_key", column)
    return lookup(df, column, table, "_vault_token", counts, hot_rows)


def vault_purge(
    vault: DataFrame, now: datetime | str | Column | None = None
) -> DataFrame:
    """The vault without expired and superseded rows, to write as its new version."""
    return vault_live(vault, now)
