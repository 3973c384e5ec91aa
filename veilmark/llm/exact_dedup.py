"""Exact duplicates of texts, built from DataFrame functions only.

Method: skew-safe combining.  Each task first merges its own copies (the map side of
the first grouping), salted digest groups are merged next, and the salts' winners
are combined into one winner per content.  The grouping key at every stage is the
digest *and* the whole content, so a digest collision can never merge two texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import join_groups, stored

SALTS = 64
WHITE = " \t\n\x0b\x0c\r"
STEP = "18446744073709551616"


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest): one row per input row.

    Texts are equal when they are the same after all ASCII white space is deleted.
    Of equal texts the one with the most code points in its original text stays,
    then the smallest id.  A null text counts as the empty text; all empty texts
    are one group.  Rows that repeat an id stand or fall together.  A null id loses
    against any other; a group of null ids only has a null ``keep_id`` and stays.
    Other columns of the input are not looked at.  No rows give no rows.

    One number holds the order of preference, ``code points * 2**64 - id``, so that
    the groupings stay hash aggregates with fixed-width buffers.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.translate(text, WHITE, "").alias("content"),
        (
            F.char_length(text).cast("decimal(38,0)") * F.expr(f"{STEP}BD")
            - F.col(id_col).cast("long")
        )
        .cast("decimal(38,0)")
        .alias("rank"),
    ).withColumn("digest", digest(F.col("content")))

    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "salt", "content")
        .agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank"))
    )
    merged = salted.groupBy("digest", "content").agg(
        F.sum("n").alias("group_size"), F.max("rank").alias("rank")
    )
    # rank = n * 2**64 - id with -2**63 <= id < 2**63: round to get n back
    points = F.expr(f"floor((rank + 9223372036854775807BD) / {STEP}BD)")
    keep = (points.cast("decimal(38,0)") * F.expr(f"{STEP}BD") - F.col("rank")).cast(
        "long"
    )
    winners = merged.select("digest", "group_size", keep.alias("keep_id"), "content")

    narrow = stored(winners.drop("content"), "exact-winners")
    collided = narrow.groupBy("digest").count().where("count > 1").head(1)
    if collided:
        # two contents share a digest: the content itself has to join rows to groups
        found = rows.join(stored(winners, "exact-contents"), ["digest", "content"])
    else:
        found = join_groups(
            rows.select("doc_id", "digest"), narrow, "digest", "group_size",
            F.col("doc_id"),
        )
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )
