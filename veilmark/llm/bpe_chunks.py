"""Byte-level BPE ids of whole texts, each distinct chunk encoded once.

A byte-level BPE splits text before any merge, and a space after a character that is
not white space always starts a new piece there.  Text cut in front of such spaces
can be encoded chunk by chunk.  Arrow cuts a block of texts and numbers its different
chunks, so each is looked up once a block.  A worker keeps the ids of chunks it has
seen, up to a fixed number, and asks the tokenizer library only for new ones.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from codecs import charmap_decode
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

KEPT_CHUNKS = 250_000
MARKS = tuple(".,;:!?")
# every character that str.isspace() accepts, before a space: there is no cut there
WHITE_PAIR = "[" + "".join(chr(c) for c in range(0x3001) if chr(c).isspace()) + "] "
CUT = re.compile(r"(?<=\S)(?= )")


class Memory(dict):
    """A table that makes missing values itself and forgets the least used half.

    Two generations of about ``kept`` entries: ``tidy`` makes a full table the old
    generation, and what is asked for again moves over.
    """

    def __init__(self, make: Callable[[str], object], kept: int) -> None:
        super().__init__()
        self.make, self.kept, self.old = make, kept, {}

    def __missing__(self, key: str) -> object:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def many(self, keys: list[str]) -> list:
        """The values of different keys, as one lookup after the other gives them."""
        values = list(map(self.get, keys))
        old, make = self.old.get, self.make
        for k in [k for k, value in enumerate(values) if value is None]:
            key = keys[k]
            value = old(key)
            if value is None:
                value = make(key)
            self[key] = values[k] = value
        return values

    def tidy(self) -> None:
        if len(self) > self.kept:
            self.old = dict(self)
            self.clear()


def space_cut(texts: pa.Array) -> pa.ListArray:
    """Texts cut in front of spaces after other characters, those spaces left out."""
    odd = pc.match_substring_regex(texts, WHITE_PAIR)
    if not pc.any(odd).as_py():
        return pc.split_pattern(texts, " ")
    plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    others = []
    for text in texts.filter(odd).to_pylist():
        parts = CUT.split(text)
        others.append(parts[:1] + [p[1:] for p in parts[1:]])
    places = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"))
    return pa.concat_arrays([plain, pa.array(others, plain.type)]).take(pa.array(places))


class ChunkEncoder:
    """``encode(texts)`` gives one array of ids per text, as the library does."""

    def __init__(self, path: str, kept: int = KEPT_CHUNKS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        spec = json.loads(self.tokenizer.to_str())
        split = spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex")
        if not plain or split.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE without a prefix space is needed")
        self.special = regex.compile(
            "|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)"
        )
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.chunks = Memory(self._chunk, kept)
        self.pieces = Memory(self._piece, kept)
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, x.ids).tobytes() for x in found]

    def _piece(self, piece: str) -> bytes:
        """The library's merges of one piece, whose bytes it takes as letters."""
        return self._merged(charmap_decode(piece.encode(), "strict", self.letters)[0])

    def _merged(self, letters: str) -> bytes:
        return array(self.code, [t.id for t in self.merge(letters)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        # letters are one piece, and so is a mark after them; other chunks are split
        if chunk.isalpha():
            # an ASCII letter is the letter of its byte
            if chunk.isascii():
                return self._merged(self.letters[0x20] + chunk)
            return self._piece(" " + chunk)
        if chunk[-1:] in MARKS and chunk[:-1].isalpha():
            return self.chunks[chunk[:-1]] + self.pieces[chunk[-1]]
        text = " " + chunk
        if self.special.search(text):
            return self._library([text])[0]
        line, end, rest = chunk.partition("\n")
        if end and rest.isalpha() and line and not line[-1].isspace():
            # a line end between other characters is one piece, and so are letters after it
            return self.chunks[line] + self.pieces[end] + self.pieces[rest]
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The arrays are views of one array for all texts."""
        if not texts:
            return []
        self.chunks.tidy()
        self.pieces.tidy()
        cut = space_cut(pa.array(texts, pa.string()))
        starts = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        parts = cut.flatten()
        is_head = np.zeros(len(parts), bool)
        is_head[starts[:-1]] = True
        heads = self._library(parts.filter(pa.array(is_head)).to_pylist())
        body = parts.filter(pa.array(~is_head)).dictionary_encode()
        different = body.dictionary.to_numpy(zero_copy_only=False).tolist()
        # a table of ids: those of the different chunks, then those of the heads
        table = self.chunks.many(different) + heads
        rows = np.empty(len(parts), np.int64)
        rows[~is_head] = body.indices.to_numpy()
        rows[is_head] = np.arange(len(different), len(table))
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // self.dtype.itemsize
        ids = np.frombuffer(b"".join(table), self.dtype)
        ends = pa.array(np.append(0, np.cumsum(sizes)))
        joined = pa.LargeListArray.from_arrays(ends, pa.array(ids)).take(pa.array(rows))
        stops = joined.offsets.to_numpy()[starts].tolist()
        found = joined.flatten().to_numpy()
        return [found[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]


# fixed value: the pattern by which byte-level BPE of this kind splits text
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def byte_letters() -> str:
    """Byte-level BPE writes each byte as a printable character: printable Latin-1
    bytes as themselves, the others from U+0100 on in order."""
    printable = set(chain(range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100)))
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b if b in printable else next(spare)) for b in range(256))


def id_type(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def text_blocks(texts: list[str], limit: int = 4 << 20):
    """(start, stop) of runs of texts with about ``limit`` characters together."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
