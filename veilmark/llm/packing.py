"""Packing of tokenized documents into training sequences.

Method: vector bin packing.  A piece is a vector of what it needs (tokens, one
segment, loss-bearing tokens), a sequence a vector of what it has left.  The pool
piece with the largest dot product of the two, each measured in shares of the limits,
goes in next; when no piece fits whole, one is cut to fill the sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.bpe_chunks import encoder, text_blocks

PIECES = (
    "doc_id long, start long, length long, doc_tokens long, "
    "sequence_id long, offset long, ids binary"
)
POOL = 512


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 128
    loss_tokens: int = 2048


class Packer:
    """Packs pieces as they come; holds about ``pool`` of them, or those that do not yet
    fill a sequence.

    A piece is (document, start, stop, loss); ``loss`` is the running number of
    loss-bearing ids of the document, so that any cut of it has its exact need.
    """

    def __init__(self, limits: Limits, pool: int = POOL) -> None:
        self.limits, self.pool = limits, pool
        self.caps = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.docs: list[tuple] = []
        self.needs = np.zeros((0, 3))
        self.fresh: list[tuple] = []
        self.sequence = 0

    def add(self, key, total: int, loss: np.ndarray | None = None) -> Iterator[tuple]:
        """Take a document of ``total`` ids; yields placed pieces
        (key, start, length, sequence, offset)."""
        start, most = 0, self.limits.tokens
        if loss is None and self.limits.loss_tokens >= most:
            while total - start >= most:
                yield key, start, most, self.sequence, 0
                self.sequence += 1
                start += most
        if start < total:
            self.fresh.append((key, start, total, loss))
        if len(self.fresh) >= self.pool:
            yield from self._pack(self.pool)

    def finish(self) -> Iterator[tuple]:
        yield from self._pack(0)

    @staticmethod
    def _loss(loss: np.ndarray | None, start: int, stop: int) -> int:
        return stop - start if loss is None else int(loss[stop] - loss[start])

    def _need(self, piece: tuple) -> tuple:
        _, start, stop, loss = piece
        return stop - start, 1, self._loss(loss, start, stop)

    def _room(self, piece: tuple, left: np.ndarray) -> int:
        """The most ids from the piece's start that fit what is left."""
        _, start, stop, loss = piece
        if left[1] < 1:
            return 0
        count = int(min(stop - start, left[0]))
        if loss is None:
            return int(min(count, left[2]))
        window = loss[start : start + count + 1] - loss[start]
        return int(np.searchsorted(window, left[2], "right")) - 1

    def _pack(self, keep: int) -> Iterator[tuple]:
        """Fill sequences until at most ``keep`` pieces are held."""
        if self.fresh:
            self.docs += self.fresh
            self.needs = np.concatenate([self.needs, [self._need(p) for p in self.fresh]])
            self.fresh = []
        while len(self.docs) > keep or (keep == 0 and self.docs):
            # short pieces wait until they fill a sequence: they are fewer than its tokens
            if keep and self.needs[: len(self.docs), 0].sum() < self.caps[0]:
                return
            placed = self._fill(keep == 0)
            if placed is None:
                return
            yield from placed

    def _take(self, k: int, count: int) -> tuple:
        """Take the first ``count`` ids of piece k out of the pool."""
        key, start, stop, loss = self.docs[k]
        if start + count == stop:
            self.docs[k] = self.docs[-1]
            self.needs[k] = self.needs[len(self.docs) - 1]
            self.docs.pop()
        else:
            self.docs[k] = (key, start + count, stop, loss)
            self.needs[k] = self._need(self.docs[k])
        return key, start, self._loss(loss, start, start + count)

    def _fill(self, last: bool) -> list[tuple]:
        """One sequence's pieces."""
        caps, tokens = self.caps, self.caps[0]
        held = int(self.needs[: len(self.docs), 0].sum())
        if last and held < tokens:
            # at the end: a sequence of a power of two ids needs no padding
            tokens = float(1 << held.bit_length() - 1)
        left = np.array([tokens, caps[1], caps[2]])
        offset, placed = 0, []
        while self.docs and left[0] >= 1 and left[1] >= 1:
            needs = self.needs[: len(self.docs)]
            gain = (needs / caps) @ (left / caps)
            fits = (needs <= left).all(1)
            if fits.any():
                k = int(np.argmax(np.where(fits, gain, -1.0)))
                count = int(needs[k, 0])
            else:
                k = int(np.argmax(gain))
                count = self._room(self.docs[k], left)
                if count < 1:
                    break
            key, start, loss = self._take(k, count)
            placed.append((key, start, count, self.sequence, offset))
            left -= (count, 1, loss)
            offset += count
        self.needs = self.needs[: len(self.docs)]
        self.sequence += 1
        return placed


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    limits: Limits = Limits(segments=2048),  # noqa: B008
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents, placed in sequences; every id lies in exactly one.

    Columns: doc_id, start and length (the piece within its document's ids),
    doc_tokens, sequence_id, offset (gapless within the sequence), ids (little-endian
    unsigned 32-bit numbers, as bytes).  A document's ids are its text's and
    ``end_id``; a null or empty text is its end id alone.  All ids of a document bear
    loss, and as many documents as fit may share a sequence, unless ``limits`` says less.  Each task packs the rows it reads and numbers its sequences from its
    partition number, so there is no shuffle, and a task that runs again gives the
    same rows.  Documents of any length stream through; the pool has a fixed size.
    Null and repeated ids are carried as they are; other columns are not looked at.
    """
    check_limits(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 32
        packer = Packer(limits)
        for batch in batches:
            names = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, stop in text_blocks(texts):
                placed = []
                encoded = work.encode(texts[start:stop])
                for name, ids in zip(names[start:stop], encoded, strict=True):
                    full = np.append(ids.astype("<u4"), np.array([end_id], "<u4"))
                    placed += packer.add((name, full), len(full))
                if placed:
                    yield rows_of(placed, base)
        placed = list(packer.finish())
        if placed:
            yield rows_of(placed, base)

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
    ).mapInArrow(run, PIECES)


def rows_of(placed: list[tuple], base: int) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array([key[0] for key, *_ in placed], pa.int64()),
            pa.array([start for _, start, *_ in placed], pa.int64()),
            pa.array([count for _, _, count, *_ in placed], pa.int64()),
            pa.array([len(key[1]) for key, *_ in placed], pa.int64()),
            pa.array([base + seq for *_, seq, _ in placed], pa.int64()),
            pa.array([offset for *_, offset in placed], pa.int64()),
            pa.array(
                [key[1][start : start + count].tobytes() for key, start, count, *_ in placed],
                pa.binary(),
            ),
        ],
        names=[c.split()[0] for c in PIECES.split(", ")],
    )


def check_limits(limits: Limits) -> None:
    if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
        raise ValueError("limits must be at least 1")


def pack_examples(
    examples: DataFrame,
    limits: Limits = Limits(),  # noqa: B008
    id_col: str = "id",
    loss_col: str = "loss_mask",
) -> DataFrame:
    """Pack tokenized instruction examples: (id, start, length, sequence_id, offset).

    ``loss_col`` is an array of booleans, one per token: whether it bears loss.  A
    null or empty mask is an example of no tokens and gives no piece; a null flag
    bears no loss.  Otherwise as ``pack_documents``.
    """
    check_limits(limits)
    names = ["id", "start", "length", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        packer = Packer(limits)
        for batch in batches:
            placed = []
            for name, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                flags = np.array([bool(x) for x in mask or ()], np.int64)
                placed += packer.add(name, len(flags), np.append(0, np.cumsum(flags)))
            yield pieces(placed, base)
        yield pieces(list(packer.finish()), base)

    def pieces(placed: list[tuple], base: int) -> pa.RecordBatch:
        columns = list(zip(*placed, strict=True)) or [[]] * 5
        arrays = [pa.array(c, pa.int64()) for c in columns]
        arrays[3] = pa.array([base + x for x in columns[3]], pa.int64())
        return pa.record_batch(arrays, names=names)

    return examples.select(
        F.col(id_col).cast("long").alias("id"), F.col(loss_col).cast("array<boolean>")
    ).mapInArrow(run, ", ".join(f"{n} long" for n in names))
