"""Chunk tables: response streams stored as (stream_id, seq, chunk, eos).

The batch operators cut every stream into blocks of equal byte size, however its
chunks were cut and however long it is, so one stream that holds a third of the
data is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.exprs import bind, inline_rows, struct, text_literal
from veilmark.functions.fixed import TOKEN_MARKER, TOKEN_MAX_BYTES, TOKEN_PATTERN
from veilmark.operators.lookup import HOT_ROWS
from veilmark.operators.rehydrate import rehydrate
from veilmark.sources.tables import stored

BLOCK_BYTES = 256 * 1024
SEQ_RANGE = 64 * 1024

_LATIN1 = "ISO-8859-1"


def with_offsets(chunks: DataFrame, seq_range: int = SEQ_RANGE) -> DataFrame:
    """Add the byte offset of each chunk in its stream, as ``_offset``, and ``_len``.

    The sums see sizes only: (stream_id, seq, length) is cut loose from the bytes,
    summed per range of ``seq`` values and then inside each range, and joined back.
    Bytes cross the network once for that join, spread by (stream_id, seq).
    A chunk delivered again repeats its bytes and keeps its place.  A chunk without a
    stream or a sequence number has no place, and fails the job rather than vanish.
    """
    lost = F.col("stream_id").isNull() | F.col("seq").isNull()
    fail = F.raise_error(F.lit("a chunk has no stream_id or seq"))
    chunks = chunks.withColumns(
        {name: F.when(lost, fail).otherwise(F.col(name)) for name in ("stream_id", "seq")}
    )
    # the filter, which the joins below imply for one side, keeps both readings of the sizes
    # equal, so that Spark sums them up and shuffles them once
    sizes = (
        chunks.groupBy("stream_id", "seq")
        .agg(F.max(F.octet_length("chunk")).cast("long").alias("_len"))
        .withColumn("_range", F.expr(f"seq div {seq_range}"))
        .where("_range IS NOT NULL")
    )
    in_range = Window.partitionBy("stream_id", "_range").orderBy("seq")
    local = sizes.withColumn("_local", F.sum("_len").over(in_range) - F.col("_len"))
    earlier = (
        Window.partitionBy("stream_id")
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranges = (
        sizes.groupBy("stream_id", "_range")
        .agg(F.sum("_len").alias("_range_len"))
        .withColumn("_base", F.coalesce(F.sum("_range_len").over(earlier), F.lit(0)))
        .drop("_range_len")
    )
    placed = local.join(ranges, ["stream_id", "_range"]).select(
        "stream_id", "seq", "_len", (F.col("_base") + F.col("_local")).alias("_offset")
    )
    return chunks.join(placed, ["stream_id", "seq"]).where(
        F.octet_length("chunk") == F.col("_len")
    )


def rechunk_batch(
    chunks: DataFrame, block_bytes: int = BLOCK_BYTES, seq_range: int = SEQ_RANGE
) -> DataFrame:
    """Finished streams as blocks that hold only whole tokens.

    Result: (stream_id, block, chunk).  Block ``b`` covers bytes
    [b * size, (b + 1) * size) of its stream; a token that crosses into the next
    block belongs to the block it starts in (so a short last block may be left
    empty).  Each block is built with the
    bytes next to it that such a token can reach into, so blocks are
    independent of each other.  In order of ``block`` the chunks of a stream are
    the stream.
    """
    reach = TOKEN_MAX_BYTES - 1
    if block_bytes <= 2 * reach:
        raise ValueError(f"block_bytes must exceed {2 * reach}")
    placed = with_offsets(chunks, seq_range).where(F.col("_len") > 0)

    first = F.expr(f"greatest(_offset - {reach}, 0) div {block_bytes}")
    last = F.expr(f"(_offset + _len - 1 + {reach}) div {block_bytes}")
    low = F.col("block") * block_bytes - reach
    high = (F.col("block") + 1) * block_bytes + reach
    pieces = placed.select(
        "stream_id",
        "_offset",
        "_len",
        "chunk",
        F.explode(F.sequence(first, last)).alias("block"),
    ).select(
        "stream_id",
        "block",
        F.greatest("_offset", low).alias("at"),
        F.substring(
            "chunk",
            (F.greatest("_offset", low) - F.col("_offset") + 1).cast("int"),
            (
                F.least(F.col("_offset") + F.col("_len"), high)
                - F.greatest("_offset", low)
            ).cast("int"),
        ).alias("bytes"),
    )

    # One character per byte, so positions are byte positions and any bytes survive.
    joined = pieces.groupBy("stream_id", "block").agg(
        F.array_sort(F.collect_set(F.struct("at", "bytes"))).alias("parts")
    )
    texts = joined.select(
        "stream_id",
        "block",
        (F.col("block") * block_bytes - F.col("parts")[0]["at"]).cast("int").alias("lead"),
        F.array_join(
            F.transform("parts", lambda p: F.decode(p["bytes"], _LATIN1)), ""
        ).alias("wide"),
    )
    # A token that crosses a cut starts within `reach` characters before it.
    begin = f"if(lead > 0, {_crossing_end('wide', 'lead', reach)}, 0)"
    own_end = f"(lead + {block_bytes})"
    end = f"if(length(wide) > {own_end}, {_crossing_end('wide', own_end, reach)}, {own_end})"
    return texts.withColumns({"_begin": F.expr(begin), "_end": F.expr(end)}).select(
        "stream_id",
        "block",
        F.expr(
            f"encode(substring(wide, _begin + 1, _end - _begin), '{_LATIN1}')"
        ).alias("chunk"),
    )


def _crossing_end(text: str, cut: str, reach: int) -> str:
    """End of the token that starts before position ``cut`` and ends after it;
    ``cut`` itself if there is none (SQL text)."""
    pattern = text_literal(TOKEN_PATTERN)
    return bind(
        bind(
            f"greatest({cut} - {reach}, 0)",
            "near",
            struct(
                start="near",
                text=f"substring({text}, near + 1, {cut} - near + {reach})",
            ),
        ),
        "win",
        f"""if(contains(win.text, '{TOKEN_MARKER}'),
        aggregate(
          zip_with(
            split(win.text, {pattern}, -1),
            regexp_extract_all(win.text, {pattern}, 0),
            (gap, tok) -> named_struct('gap', length(gap), 'len', coalesce(length(tok), 0))),
          named_struct('pos', win.start, 'end', {cut}),
          (acc, x) -> named_struct(
            'pos', acc.pos + x.gap + x.len,
            'end', if(acc.pos + x.gap < {cut} AND acc.pos + x.gap + x.len > {cut},
                      acc.pos + x.gap + x.len, acc.`end`)),
          acc -> acc.`end`),
        {cut})""",
    )


def rehydrate_blocks(
    blocks: DataFrame,
    vault: DataFrame,
    keys: list[str],
    now: datetime | str | Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Restore tokens in BINARY ``chunk`` rows that hold only whole tokens."""
    as_text = blocks.withColumn("chunk", F.decode("chunk", _LATIN1))
    values = vault.withColumn(
        "value", F.decode(F.encode("value", "UTF-8"), _LATIN1)
    )
    restored = rehydrate(as_text, values, keys, "chunk", now, hot_rows)
    return restored.withColumn("chunk", F.encode("chunk", _LATIN1))


def rehydrate_chunks_batch(
    chunks: DataFrame,
    vault: DataFrame,
    now: datetime | str | Column | None = None,
    block_bytes: int = BLOCK_BYTES,
    seq_range: int = SEQ_RANGE,
) -> DataFrame:
    """Restore finished streams: (stream_id, block, chunk).

    The blocks are stored first: restoring reads them several times, and cutting
    them is the costly part.
    """
    return rehydrate_blocks(
        stored(rechunk_batch(chunks, block_bytes, seq_range)),
        vault,
        ["stream_id", "block"],
        now,
    )


def chunk_texts(df: DataFrame, key: str, text: str, chunk_chars: int) -> DataFrame:
    """Cut a text column into a chunk table, ``chunk_chars`` code points each.

    The inverse of concatenating a stream; used to feed stored text to chunk
    consumers.
    """
    # a regex cuts in one pass; substring would count from the start each time
    cuts = f"regexp_extract_all({text}, '(?s).{{1,{chunk_chars}}}', 0)"
    pieces = bind(
        f"if({text} = '', array(''), {cuts})",
        "cuts",
        """transform(cuts, (c, i) -> named_struct(
            'seq', i, 'chunk', cast(c as binary), 'eos', i = size(cuts) - 1))""",
    )
    rows = df.select(F.col(key).alias("stream_id"), F.expr(pieces).alias("_pieces"))
    return inline_rows(rows, ["stream_id"], "_pieces")
