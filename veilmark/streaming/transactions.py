"""Requests and their responses as one transaction.

A response may only give back what its own request held: its tokens are looked up in the
mappings of that request, not in a vault that all share.  Both sides are streams; watermarks
and a longest duration bound what is kept of either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.exprs import bind
from veilmark.functions.tokens import find_tokens, has_marker, splice_values

_LATIN1 = "ISO-8859-1"
RESTORED, NO_REQUEST, NO_RESPONSE = "restored", "no_request", "no_response"


def restored_by(chunk: str, mappings: str) -> Column:
    """Bytes of ``chunk`` with the tokens that are in ``mappings`` replaced by their values."""
    # one character per byte, so a chunk may cut a character
    entries = (
        f"transform({mappings}, m -> named_struct('key', m.token, "
        f"'value', decode(encode(m.value, 'UTF-8'), '{_LATIN1}')))"
    )
    # a value found twice has one mapping per place: equal ones, so either will do
    values = bind(
        f"map_from_entries(array_distinct({entries}))",
        "known",
        f"transform({find_tokens('txt')}, t -> coalesce(try_element_at(known, t), t))",
    )
    whole = bind(
        f"decode({chunk}, '{_LATIN1}')",
        "txt",
        f"if(size({mappings}) > 0 AND {has_marker('txt')}, {bind(values, 'vals', splice_values('txt', 'vals'))}, txt)",
    )
    return F.encode(F.expr(whole), _LATIN1)


def restore_transactions(
    requests: DataFrame,
    responses: DataFrame,
    longest_seconds: int = 3600,
    late_seconds: int = 600,
) -> DataFrame:
    """(request_id, seq, chunk, status, ts): responses with their own request's values.

    ``requests`` has (request_id, ts, mappings) as ``redact`` gives them, ``responses``
    (request_id, seq, chunk, ts) whose chunks hold only whole tokens (``rechunk_stream``,
    ``rechunk_batch``).  A response belongs to the request of its id if it comes at most
    ``longest_seconds`` after it.  A response without one keeps its tokens and is marked
    ``no_request``; a request that gets none gives a row ``no_response`` without a chunk.  Both
    come out when the watermark shows that no partner can follow.  A request that comes again
    within the watermark counts once.

    For streams, rows that are ``late_seconds`` behind are dropped by Spark, as with every
    event-time join; route them beforehand if they matter.  On tables the result is the
    same without any lateness.  State holds the requests and responses of about
    ``longest_seconds + late_seconds``.
    """
    late = f"{late_seconds} seconds"
    asked = requests.select(
        F.col("request_id").alias("_asked"), F.col("ts").alias("_asked_at"), F.col("mappings").alias("_mappings")
    )
    if asked.isStreaming:
        asked = asked.withWatermark("_asked_at", late).dropDuplicatesWithinWatermark(["_asked"])
        responses = responses.withWatermark("ts", late)
    else:
        asked = asked.groupBy("_asked").agg(
            F.min(F.struct("_asked_at", "_mappings")).alias("_first")
        ).select("_asked", "_first.*")
    answers = responses.select("request_id", "seq", "chunk", "ts")
    together = (
        (F.col("request_id") == F.col("_asked"))
        & (F.col("ts") >= F.col("_asked_at"))
        & (F.col("ts") <= F.col("_asked_at") + F.make_dt_interval(secs=F.lit(longest_seconds)))
    )
    joined = answers.join(asked, together, "full_outer")
    status = (
        F.when(F.col("_asked").isNull(), NO_REQUEST)
        .when(F.col("request_id").isNull(), NO_RESPONSE)
        .otherwise(RESTORED)
    )
    return joined.select(
        F.coalesce("request_id", "_asked").alias("request_id"),
        "seq",
        F.when(F.col("_asked").isNull(), F.col("chunk"))
        .otherwise(restored_by("chunk", "_mappings"))
        .alias("chunk"),
        status.alias("status"),
        F.coalesce("ts", "_asked_at").alias("ts"),
    )
