"""Hashes of all windows of a text, for finding many terms at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)


def _powers(base: int, count: int) -> np.ndarray:
    powers = np.full(count, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


class RunningHash:
    """Hashes of all windows of a text, for any window size, from one running sum."""

    def __init__(self, text: str) -> None:
        points = _points(text)
        terms = (points + np.uint64(1)) * _powers(BASE, len(points))
        self.sums = np.append(np.uint64(0), np.cumsum(terms, dtype=np.uint64))
        self.shift = _powers(INVERSE, len(points))

    def windows(self, size: int, bits: int) -> np.ndarray:
        """Bitmap slot of each window of ``size`` code points."""
        count = max(len(self.sums) - size, 0)
        found = (self.sums[size:] - self.sums[:count]) * self.shift[:count]
        found = (found ^ (found >> np.uint64(32))) * np.uint64(BASE) + np.uint64(size)
        return (found ^ (found >> np.uint64(29))) * np.uint64(BASE) >> np.uint64(64 - bits)


BITMAP_BITS = (20, 27)
PER_TERM = 16


def bitmap_bits(terms: int) -> int:
    """Bits of a slot for so many terms: 16 slots a term, within bounds."""
    least, most = BITMAP_BITS
    return min(max((PER_TERM * terms).bit_length(), least), most)


def term_slot(term: str, bits: int) -> int:
    return int(RunningHash(term).windows(len(term), bits)[0])


def bitmap_of(terms: Iterable[str], bits: int) -> np.ndarray:
    bitmap = np.zeros(1 << bits - 6, np.uint64)
    for term in terms:
        slot = term_slot(term, bits)
        bitmap[slot >> 6] |= np.uint64(1 << (slot & 63))
    return bitmap


def candidates(text: str, bitmap: np.ndarray, sizes: list[int], bits: int) -> Iterator[tuple[int, str]]:
    """(position, window) of the windows of these sizes whose slot is marked."""
    hashes = RunningHash(text)
    for size in sizes:
        slots = hashes.windows(size, bits)
        hit = bitmap[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))
        for at in np.flatnonzero(hit & np.uint64(1)).tolist():
            yield at, text[at : at + size]


RUN_CHARS = 1 << 18


def text_runs(sizes: np.ndarray, limit: int = RUN_CHARS) -> Iterator[tuple[int, int]]:
    """(start, stop) of neighbours with at most ``limit`` characters together, or of one."""
    start, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > start and total + size > limit:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def candidates_of(
    texts: list[str | None], bitmap: np.ndarray, sizes: list[int], bits: int
) -> list[list[tuple[int, str]]]:
    """The ``candidates`` of each text, from one running hash over all of them: a window's
    slot does not depend on where it lies.  Windows that begin in one text and end in
    another are left out."""
    found: list[list[tuple[int, str]]] = [[] for _ in texts]
    whole = "".join(t or "" for t in texts)
    ends = np.cumsum([len(t or "") for t in texts])
    hashes = RunningHash(whole)
    for size in sizes:
        slots = hashes.windows(size, bits)
        hit = bitmap[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))
        at = np.flatnonzero(hit & np.uint64(1))
        owner = np.searchsorted(ends, at, "right")
        inside = at + size <= ends[owner]
        starts = at - np.append(0, ends)[owner]
        for k, i, a in zip(owner[inside].tolist(), at[inside].tolist(), starts[inside].tolist()):
            found[k].append((a, whole[i : i + size]))
    return found
