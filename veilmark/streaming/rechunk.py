"""Stateful re-cutting of live chunk streams.

Streams are dealt to a fixed number of buckets by the hash of their id, and a bucket is one
key of the state, so a call of Python, its frames and its requests to the state store serve
many streams; the chunks of a bucket cross the shuffle in packs.  A bucket's state is a few pages with the places of its streams (the next
``seq`` to emit, the bytes held back because a token may be open at their end, which chunks
wait in which parcel, the ranges of numbers given out of turn), and parcels of the chunks
that arrived ahead of their turn.  A parcel is written once and read when one of its
chunks is due, so a stream with a wide gap does not rewrite all it holds at each
micro-batch.  A stream that has ended leaves its place, so that a chunk delivered again
is not emitted again, and one that was never seen is told apart and goes out as late: no
byte is lost.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from veilmark.functions.fixed import (
    TOKEN_ID_LENGTH,
    TOKEN_LABEL_LENGTH,
    TOKEN_MARKER,
    TOKEN_MAX_BYTES,
)

OUT_SCHEMA = "stream_id bigint, seq bigint, chunk binary, eos boolean, reason string"
ENDED_SECONDS = 3600
# fixed values: a checkpoint's state is kept by bucket and page
BUCKETS, PAGES = 512, 32
PARCEL_CHUNKS, PARCEL_BYTES = 64, 256 << 10
PACKED_ROWS, PACKED_BYTES = 256, 4 << 10
HELD_BYTES = 64 << 20
_LAST = (1 << 63) - 1
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _beginnings() -> re.Pattern[bytes]:
    """Matches a tail that is the beginning of a token and not yet a whole one.

    By the token's grammar: part of the marker; the marker and label characters, of
    which the last may already be digits of the id; label and id with or without
    the first closing bracket.
    """
    marker = ""
    for char in reversed(TOKEN_MARKER[1:]):
        marker = f"(?:{re.escape(char)}{marker})?"
    label = f"[A-Z0-9_]{{1,{TOKEN_LABEL_LENGTH}}}_"
    rest = "|".join(
        (
            f"[A-Z0-9_]{{0,{TOKEN_LABEL_LENGTH + 1 + TOKEN_ID_LENGTH}}}",
            f"{label}[0-9a-f]{{1,{TOKEN_ID_LENGTH}}}",
            f"{label}[0-9a-f]{{{TOKEN_ID_LENGTH}}}\\]",
        )
    )
    whole = f"(?:{re.escape(TOKEN_MARKER)}(?:{rest})|{re.escape(TOKEN_MARKER[0])}{marker})\\Z"
    return re.compile(whole.encode())


_BEGINNING = _beginnings()


def open_token_at(data: bytes) -> int:
    """Where the longest tail of ``data`` starts that more bytes could make a token,
    or the length of ``data`` when there is none."""
    found = _BEGINNING.search(data, max(0, len(data) - TOKEN_MAX_BYTES + 1))
    return found.start() if found else len(data)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    ids, seqs, chunks, ends, reasons = zip(*rows) if rows else ((),) * 5
    return pd.DataFrame(
        {
            # a null beside it must not make a large id a float
            "stream_id": pd.array(ids, "Int64"),
            "seq": pd.array(seqs, "Int64"),
            "chunk": pd.Series(chunks, dtype=object),
            "eos": pd.Series(ends, dtype=bool),
            "reason": pd.Series(reasons, dtype=object),
        }
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket that lie in one Arrow batch, a few kilobytes at a time, as one row."""
    for batch in batches:
        buckets: list[int] = []
        packed: list[bytes] = []
        open_rows: dict[int, list[tuple]] = {}
        sizes: dict[int, int] = {}

        def flush(bucket: int) -> None:
            buckets.append(bucket)
            packed.append(pickle.dumps(open_rows.pop(bucket), 5))

        for bucket, *row in zip(*(column.to_pylist() for column in batch.columns)):
            if bucket not in open_rows:
                open_rows[bucket], sizes[bucket] = [], 0
            open_rows[bucket].append(tuple(row))
            sizes[bucket] += len(row[2] or b"")
            if sizes[bucket] >= PACKED_BYTES or len(open_rows[bucket]) >= PACKED_ROWS:
                flush(bucket)
        for bucket in list(open_rows):
            flush(bucket)
        yield pa.record_batch([pa.array(buckets, pa.int64()), pa.array(packed, pa.binary())], ["bucket", "packed"])


class Stream:
    """One stream's place."""

    __slots__ = ("next_seq", "carry", "closed", "waiting", "given", "due", "ahead")

    def __init__(self, next_seq=0, carry=b"", closed=False, waiting=None, given=None, due=None) -> None:
        self.next_seq, self.carry, self.closed, self.due = next_seq, carry, closed, due
        self.waiting: dict[int, int] = waiting or {}  # seq to the parcel that holds it
        self.given: list[list[int]] = given or []  # ranges of numbers, ends included
        self.ahead: dict[int, tuple[bytes, bool]] = {}  # arrived in this micro-batch

    def place(self) -> tuple:
        return self.next_seq, self.carry, self.closed, self.waiting, self.given, self.due

    def was_given(self, seq: int) -> bool:
        at = bisect_right(self.given, [seq, _LAST])
        return at > 0 and seq <= self.given[at - 1][1]

    def give(self, seq: int) -> None:
        """Note a number that was not given before."""
        ranges = self.given
        at = bisect_right(ranges, [seq, _LAST])
        before = at > 0 and ranges[at - 1][1] == seq - 1
        behind = at < len(ranges) and ranges[at][0] == seq + 1
        if before and behind:
            ranges[at - 1][1] = ranges.pop(at)[1]
        elif before:
            ranges[at - 1][1] = seq
        elif behind:
            ranges[at][0] = seq
        else:
            ranges.insert(at, [seq, seq])


class Page:
    """Some streams of a bucket, as they lie together in the state."""

    def __init__(self, number: int, places, parcels) -> None:
        self.number, self.parcels = number, parcels
        found = places.getValue((number,))
        # parcels made so far, and how many waiting chunks each still holds
        self.made, self.left, kept = pickle.loads(bytes(found[0])) if found else (0, {}, {})
        self.streams = {name: Stream(*place) for name, place in kept.items()}
        self.opened: dict[int, dict] = {}

    def take(self, name: str, stream: Stream, seq: int) -> tuple[bytes, bool]:
        """A waiting chunk, out of its parcel; an empty parcel leaves the state."""
        number = stream.waiting.pop(seq)
        if number not in self.opened:
            (packed,) = self.parcels.getValue((self.number, number))
            self.opened[number] = {(n, s): (c, e) for n, s, c, e in pickle.loads(bytes(packed))}
        found = self.opened[number].pop((name, seq))
        self.left[number] -= 1
        if not self.left[number]:
            del self.left[number], self.opened[number]
            self.parcels.removeKey((self.number, number))
        return found

    def take_all(self, name: str, stream: Stream) -> dict[int, tuple[bytes, bool]]:
        """Every chunk a stream holds."""
        held, stream.ahead = stream.ahead, {}
        for seq in list(stream.waiting):
            held[seq] = self.take(name, stream, seq)
        return held

    def _parcel(self, chunks: list[tuple]) -> None:
        self.parcels.updateValue((self.number, self.made), (pickle.dumps(chunks, 5),))
        for name, seq, _, _ in chunks:
            self.streams[name].waiting[seq] = self.made
        self.left[self.made] = len(chunks)
        self.made += 1

    def keep(self, places) -> None:
        """Put the page and what arrived ahead into the state."""
        chunks: list[tuple] = []
        size = 0
        for name, stream in self.streams.items():
            ahead, stream.ahead = stream.ahead, {}
            for seq in sorted(ahead):
                data, eos = ahead[seq]
                chunks.append((name, seq, data, eos))
                size += len(data)
                if len(chunks) == PARCEL_CHUNKS or size >= PARCEL_BYTES:
                    self._parcel(chunks)
                    chunks, size = [], 0
        if chunks:
            self._parcel(chunks)
        kept = {name: stream.place() for name, stream in self.streams.items()}
        if kept:
            places.updateValue((self.number,), (pickle.dumps((self.made, self.left, kept), 5),))
        else:
            places.removeKey((self.number,))


class ChunkOrder(StatefulProcessor):
    """Puts the chunks of a bucket's streams in order and holds back what ``open_at`` says
    is open."""

    def __init__(
        self,
        open_at: Callable[[bytes], int],
        idle_ms: int | None,
        ended_ms: int,
        held_bytes: int = HELD_BYTES,
    ) -> None:
        self.open_at, self.idle_ms, self.ended_ms = open_at, idle_ms, ended_ms
        self.held_bytes = held_bytes

    def init(self, handle) -> None:
        self.handle = handle
        # streams are named by text: '' is the one whose id is null
        self.places = handle.getMapState("places", "page int", "packed binary")
        self.parcels = handle.getMapState("parcels", "page int, parcel bigint", "packed binary")
        # streams touched at a time: those not touched since are due when it comes
        self.alarms = handle.getMapState("alarms", "due bigint", "streams array<string>")

    def close(self) -> None:
        pass

    def _page(self, pages: dict[int, Page], name: str) -> Page:
        number = crc32(name.encode()) % PAGES
        if number not in pages:
            pages[number] = Page(number, self.places, self.parcels)
        return pages[number]

    def _release(self, page: Page, name: str, stream: Stream) -> list[tuple]:
        """Everything held, in order, as one chunk; what was ahead counts as given."""
        held = page.take_all(name, stream)
        order = sorted(held)
        for seq in order:
            stream.give(seq)
        rest = stream.carry + b"".join(held[seq][0] for seq in order)
        last = max(held, default=stream.next_seq)
        stream.carry, stream.closed = b"", True
        return [(_id(name), last, rest, True, "timeout")] if rest else []

    def _late(self, name: str, stream: Stream, seq: int, data: bytes, eos: bool) -> list[tuple]:
        if seq < stream.next_seq or stream.was_given(seq):
            return []  # delivered again
        stream.give(seq)
        return [(_id(name), seq, data, eos, "late")]

    def _emit(self, page: Page, name: str, stream: Stream) -> list[tuple]:
        """What is in turn, up to the stream's end."""
        out: list[tuple] = []
        while not stream.closed and (stream.next_seq in stream.ahead or stream.next_seq in stream.waiting):
            seq = stream.next_seq
            data, closed = stream.ahead.pop(seq) if seq in stream.ahead else page.take(name, stream, seq)
            data = stream.carry + data
            cut = len(data) if closed else self.open_at(data)
            ready, stream.carry = data[:cut], data[cut:]
            if ready or closed:
                out.append((_id(name), seq, ready, closed, "eos" if closed else "chunk"))
            stream.next_seq, stream.closed = seq + 1, closed
        if stream.closed and (stream.ahead or stream.waiting):
            # what lies beyond the end was not expected, and is not lost
            held = page.take_all(name, stream)
            for seq in sorted(held):
                out += self._late(name, stream, seq, *held[seq])
        return out

    def _keep(self, pages: dict[int, Page], touched: set[str], now_ms: int | None) -> None:
        """Put pages back into the state, with an alarm for what was touched."""
        alarms: dict[int, list[str]] = {}
        for name in touched if now_ms is not None else ():
            stream = self._page(pages, name).streams[name]
            stream.due = now_ms + (self.ended_ms if stream.closed else self.idle_ms)
            alarms.setdefault(stream.due, []).append(name)
        for page in pages.values():
            page.keep(self.places)
        for due, names in alarms.items():
            before = self.alarms.getValue((due,))
            self.alarms.updateValue((due,), ([*(before[0] if before else ()), *names],))
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now_ms = None if self.idle_ms is None else timerValues.getCurrentProcessingTimeInMs()
        pages: dict[int, Page] = {}
        touched: set[str] = set()
        held = 0
        for pdf in rows:
            out: list[tuple] = []
            seen: dict[str, tuple[Page, Stream]] = {}
            broken: set[str] = set()
            given = (row for packed in pdf["packed"] for row in pickle.loads(packed))
            for name, seq, chunk, eos in given:
                if name not in seen:
                    page = self._page(pages, name)
                    seen[name] = page, page.streams.setdefault(name, Stream())
                stream, data = seen[name][1], chunk or b""
                if seq is None:
                    if eos:
                        broken.add(name)
                elif stream.closed:
                    out += self._late(name, stream, seq, data, eos)
                elif seq >= stream.next_seq and seq not in stream.waiting:
                    stream.ahead.setdefault(seq, (data, eos))
                    held += len(data)
            # Emit after every Arrow batch: memory holds gaps, not the streams.
            for name, (page, stream) in seen.items():
                out += self._emit(page, name, stream)
                if name in broken and not stream.closed:
                    out += self._release(page, name, stream)
            touched.update(seen)
            yield _rows(out)
            if held > self.held_bytes:
                self._keep(pages, touched, now_ms)
                pages, touched, held = {}, set(), 0
        self._keep(pages, touched, now_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = int(expiredTimerInfo.getExpiryTimeInMs())
        alarm = self.alarms.getValue((due,))
        self.alarms.removeKey((due,))
        out: list[tuple] = []
        pages: dict[int, Page] = {}
        released: set[str] = set()
        for name in dict.fromkeys(alarm[0] if alarm else ()):
            page = self._page(pages, name)
            stream = page.streams.get(name)
            if stream is None or stream.due != due:
                continue  # touched again since
            if stream.closed:
                del page.streams[name]
            else:
                # The end never came: give out all that is held, in order.
                out += self._release(page, name, stream)
                released.add(name)
        self._keep(pages, released, timerValues.getCurrentProcessingTimeInMs())
        yield _rows(out)


def _id(name: str) -> int | None:
    return int(name) if name else None


def rechunk_stream(
    chunks: DataFrame,
    idle_seconds: int | None = 300,
    ended_seconds: int = ENDED_SECONDS,
    open_at: Callable[[bytes], int] = open_token_at,
) -> DataFrame:
    """Streaming (stream_id, seq, chunk, eos) to chunks that hold only whole tokens.

    Chunks may arrive in any order; they are emitted in order of ``seq``, which
    counts from 0 in each stream.  Concatenated output equals concatenated
    input.  At ``eos`` everything is released; a stream that stays silent for
    ``idle_seconds``, or of which a row without ``seq`` but with ``eos`` says that it broke off, is
    released too, marked ``reason='timeout'``.  A chunk that comes for the first time
    after that, or lies beyond the end, goes out by itself as ``reason='late'``: emitted and late
    chunks together are the input, under any delay.  Processing time is used, because an
    event-time watermark would make Spark drop late chunks.

    Chunks that come again after the end are ignored for ``ended_seconds``, so a stream id must
    not be used anew before.  A query with such a timeout runs until it is stopped; for an
    ``availableNow`` run pass ``idle_seconds=None``: streams without an end, and the marks of
    ended ones, then stay in the state for the next run.  ``open_at`` says from where on a
    stream's bytes must wait for more.  The state needs the RocksDB store, which is set for
    the session.
    """
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    processor = ChunkOrder(
        open_at, None if idle_seconds is None else idle_seconds * 1000, ended_seconds * 1000
    )
    return (
        chunks.select(
            F.pmod(F.xxhash64(F.col("stream_id").cast("bigint")), F.lit(BUCKETS)).alias("bucket"),
            F.coalesce(F.col("stream_id").cast("bigint").cast("string"), F.lit("")).alias("stream"),
            F.col("seq").cast("bigint"),
            F.col("chunk").cast("binary"),
            F.coalesce("eos", F.lit(False)).alias("eos"),
        )
        .mapInArrow(_packed, "bucket bigint, packed binary")
        .groupBy("bucket")
        .transformWithStateInPandas(
            processor,
            OUT_SCHEMA,
            "Append",
            "None" if idle_seconds is None else "ProcessingTime",
        )
    )
