"""Restoration: tokens in text back to values, by joining the vault.

Replacement is one pass over the given text: a restored value is never scanned
again, unknown and expired tokens stay as they are, and no row is ever dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.exprs import where_once
from veilmark.functions.tokens import find_tokens, has_marker, splice_values
from veilmark.operators.lookup import HOT_ROWS
from veilmark.operators.vault import resolve


def rehydrate(
    df: DataFrame,
    vault: DataFrame,
    keys: str | Sequence[str] | None = None,
    text: str = "text",
    now: datetime | str | Column | None = None,
    hot_rows: int = HOT_ROWS,
    scope: str | None = None,
) -> DataFrame:
    """Restore the tokens of ``text``.

    What a text becomes depends on the text alone, so rows are told apart by the
    digest of their text: ``keys`` is not needed, may hold nulls and may repeat.
    Rows without a token skip every shuffle.  For the others only
    (digest, position, token) goes to the vault join; the values come back as one
    array per text, in order, and are spliced between the gaps.  Copies of a text
    are resolved once.  With a ``scope`` column, a row's tokens are looked up in its scope
    alone, in a vault whose tokens are ``scoped``; a null scope has no tokens.
    """
    name = F.col(text) if scope is None else scoped(scope, text)
    digest = F.sha2(name.cast("binary"), 256)
    with_tokens = where_once(df, has_marker(text)).withColumn("_digest", digest)
    without = where_once(df, f"NOT coalesce({has_marker(text)}, false)")

    plain = tokens_long(
        with_tokens.withColumn("_scope", F.lit(None) if scope is None else F.col(scope)),
        ["_digest", "_scope"],
        text,
    ).withColumnsRenamed({"pos": "_pos", "token": "_plain"})
    token = F.col("_plain") if scope is None else scoped("_scope", "_plain")
    occurrences = plain.withColumn("_token", token).drop("_scope").distinct()
    resolved = (
        resolve(occurrences, "_token", vault, "_value", now, hot_rows)
        .groupBy("_digest")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col("_pos"),
                        F.coalesce("_value", "_plain").alias("_value"),
                    )
                )
            ).alias("_found")
        )
    )
    restored = (
        with_tokens.join(resolved, "_digest", "left")
        .withColumn(
            text,
            F.when(F.col("_found").isNull(), F.col(text)).otherwise(
                F.expr(splice_values(text, "_found._value"))
            ),
        )
        .select(*df.columns)
    )
    return without.unionByName(restored)


def scoped(scope: str, token: str) -> Column:
    """A token's name in a vault that several scopes share; null without a scope."""
    return F.concat(F.col(scope).cast("string"), F.lit("\x1f"), F.col(token))


def tokens_long(
    df: DataFrame, keys: str | Sequence[str], text: str = "text"
) -> DataFrame:
    """One row per token occurrence: keys, pos, token."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    # outer: see exprs.inline_rows
    return (
        where_once(df, has_marker(text))
        .select(*keys, F.posexplode_outer(F.expr(find_tokens(text))).alias("pos", "token"))
        .where(F.col("token").isNotNull())
    )
