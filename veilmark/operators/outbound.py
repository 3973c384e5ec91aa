"""Detection and redaction in response streams: no finding is missed at a chunk's edge.

A stream may be parted behind white space where no rule can match across: behind a tab,
line end or form feed always, behind a space unless digits or brackets stand on both sides
(card and phone numbers have single spaces there).  On either side of such a place rules
find what they find in the whole text, so the parts are redacted independently.  Only
the bytes between the last such place of one block and the first of the next must
wait for each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.exprs import MAPPINGS, empty, where_once
from veilmark.operators.chunks import BLOCK_BYTES, SEQ_RANGE, rechunk_batch
from veilmark.operators.detect import detect_regex
from veilmark.operators.redact import redact
from veilmark.options import Options
from veilmark.sources.tables import stored

_LATIN1 = "ISO-8859-1"
# a neighbour that is not known counts as a digit
PARTING = r"(?:[\t\n\f\r]|(?<=[^0-9)]) | (?=[^0-9(]))"
_PARTING = re.compile(PARTING.encode())
_WINDOW = 1 << 12


def open_match_at(data: bytes) -> int:
    """Behind the last place where ``data`` may be parted: what follows must wait for
    more bytes.  0 when there is no such place.  Looks from the end backwards."""
    stop = len(data)
    while stop > 0:
        start = max(0, stop - _WINDOW)
        # one byte more on each side lets neighbours be seen
        last = None
        for last in _PARTING.finditer(data, max(0, start - 1), min(len(data), stop + 1)):
            pass
        if last is not None:
            return last.end()
        stop = start
    return 0


def parted(
    chunks: DataFrame, block_bytes: int = BLOCK_BYTES, seq_range: int = SEQ_RANGE
) -> DataFrame:
    """Finished streams as independent texts: (stream_id, block, part, text, valid).

    In order of (block, part) the texts are the stream.  What lies between the first and
    the last parting place of a block of equal byte size stays where it is; only the block's
    two ends travel, to be joined with their neighbours'.  A block without a parting place
    joins the one before and the one behind, so a run that may be one finding, whatever
    its length, is seen whole.  ``valid`` is false where the bytes are not UTF-8; ``text`` is
    null then and ``bytes`` has them as they are.
    """
    blocks = rechunk_batch(chunks, block_bytes, seq_range)
    wide = F.decode("chunk", _LATIN1)
    first = F.regexp_extract("wide", f"(?s)^.*?{PARTING}", 0)
    last = F.regexp_extract("wide", f"(?s)^.*{PARTING}", 0)
    cut = stored(
        where_once(blocks, "octet_length(chunk) > 0")
        .select("stream_id", "block", wide.alias("wide"))
        .select(
            "stream_id",
            "block",
            "wide",
            F.length(first).alias("first"),
            F.length(last).alias("last"),
        )
    )
    # which run each end belongs to: over one small row a block
    order = Window.partitionBy("stream_id").orderBy("block")
    runs = cut.select("stream_id", "block", (F.col("last") > 0).cast("long").alias("has"))
    runs = runs.withColumn("run", F.sum("has").over(order)).drop("has")
    middle = cut.where("last > first").select(
        "stream_id",
        "block",
        F.lit(0).alias("part"),
        F.expr("substring(wide, first + 1, last - first)").alias("wide"),
    )
    # an end's run is not known yet: heads close the run that the tail before them opened
    ends = cut.select(
        "stream_id",
        "block",
        F.explode(
            F.expr(
                """if(last = 0, array(named_struct('back', 0, 'wide', wide)),
                   array(named_struct('back', 1, 'wide', substring(wide, 1, first)),
                         named_struct('back', 0, 'wide', substring(wide, last + 1))))"""
            )
        ).alias("end"),
    ).select("stream_id", "block", "end.back", "end.wide")
    joined = (
        # an empty tail still tells where its run stands
        ends.join(runs, ["stream_id", "block"])
        .groupBy("stream_id", (F.col("run") - F.col("back")).alias("run"))
        .agg(
            F.min("block").alias("block"),
            F.array_sort(F.collect_list(F.struct("block", "wide"))).alias("pieces"),
        )
        .select(
            "stream_id",
            "block",
            # nothing opened the first run: it stands in front of its block's middle
            F.when(F.col("run") == 0, -1).otherwise(1).alias("part"),
            F.array_join("pieces.wide", "").alias("wide"),
        )
        .where("wide <> ''")
    )
    data = F.encode("wide", _LATIN1)
    both = middle.unionByName(joined).select("stream_id", "block", "part", data.alias("bytes"))
    valid = F.is_valid_utf8(F.col("bytes").cast("string"))
    return both.withColumn("valid", valid).withColumn(
        "text", F.when(F.col("valid"), F.col("bytes").cast("string"))
    )


def detect_chunks(
    chunks: DataFrame,
    entities: Iterable[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
    seq_range: int = SEQ_RANGE,
) -> DataFrame:
    """(stream_id, entity_type, start, end, score): what the built-in rules find in finished
    streams, counted in code points from the stream's start.

    The same as detection in the whole text, for every way the stream was cut.  Offsets
    come from a running sum over one small row a part.  Bytes that are not UTF-8 are not
    inspected and count as one code point each.
    """
    parts = parted(chunks, block_bytes, seq_range)
    found = detect_regex(parts, entities=entities).select(
        "stream_id",
        "block",
        "part",
        F.coalesce(F.char_length("text"), F.octet_length("bytes")).cast("long").alias("size"),
        F.filter("findings", lambda f: f["start"] >= 0).alias("findings"),
    )
    order = Window.partitionBy("stream_id").orderBy("block", "part")
    placed = found.withColumn("_at", F.sum("size").over(order) - F.col("size"))
    return placed.select("stream_id", "_at", F.inline("findings")).select(
        "stream_id",
        "entity_type",
        (F.col("_at") + F.col("start")).alias("start"),
        (F.col("_at") + F.col("end")).alias("end"),
        "score",
    )


def redact_chunks(
    chunks: DataFrame,
    options: Options,
    block_bytes: int = BLOCK_BYTES,
    seq_range: int = SEQ_RANGE,
) -> DataFrame:
    """Finished streams with their findings replaced: (stream_id, block, part, chunk,
    mappings, status).

    In order of (block, part) the chunks of a stream are its redacted bytes, equal to those
    of the whole text.  Bytes that are not UTF-8 count as a detection that failed: kept and
    ``passed_uninspected``, or null and ``rejected``, by ``options.on_error``.  For the
    ``regex`` backend, whose rules decide where a stream may be parted.
    """
    only_rules(options)
    return redact_parts(parted(chunks, block_bytes, seq_range), options).select(
        "stream_id", "block", "part", "chunk", "mappings", "status"
    )


def only_rules(options: Options) -> None:
    if options.backend != "regex":
        raise ValueError("streams are parted by the built-in rules: use the regex backend")


def redact_parts(parts: DataFrame, options: Options) -> DataFrame:
    """Redact ``text`` of parts with ``bytes`` and ``valid``; the result is ``chunk``."""
    done = redact(parts, options)
    kept = F.lit(None).cast("binary") if options.on_error == "closed" else F.col("bytes")
    status = "rejected" if options.on_error == "closed" else "passed_uninspected"
    return done.withColumns(
        {
            "chunk": F.when(F.col("valid"), F.col("text").cast("binary")).otherwise(kept),
            "mappings": F.coalesce("mappings", F.expr(empty(MAPPINGS))),
            "status": F.when(F.col("valid"), F.col("status")).otherwise(status),
        }
    ).drop("text", "bytes", "valid")
