"""SentencePiece encoding and decoding of whole texts.

Method: distinct-chunk table.  Where no piece of the model holds a white space mark
after another character, no merge can cross such a place.  A text is cut there
into marked words; each distinct marked word is segmented once by the library and
kept in a table, and a text's ids are the table's entries joined by position.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.bpe_chunks import Memory, text_blocks

MARK = "▁"
KEPT_WORDS = 250_000
CROSSING = re.compile(f"[^{MARK}]{MARK}")
CUT = re.compile("(?<=[^ ])(?= )")


class PieceCodec:
    """Segments texts by the distinct-chunk table, as the library does."""

    def __init__(self, path: str, kept: int = KEPT_WORDS) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        if any(CROSSING.search(self.model.id_to_piece(k)) for k in range(size)):
            raise ValueError("pieces of this model cross white space marks")
        # a normalizer that maps characters could look across a cut
        if self.model.normalize("a  b ﬁ c") != f"{MARK}a{MARK}{MARK}b{MARK}ﬁ{MARK}c":
            raise ValueError("a model without text normalization is needed")
        self.table = Memory(self._word, kept)

    def _word(self, word: str) -> tuple[list[int], str, str]:
        """(ids, the same as decimal text, decoded word) of a word.

        A word comes without its first mark, which the library puts in front of
        every text; the word of a mark alone is the piece of the mark.
        """
        ids = self.model.encode(word) if word else [self.model.piece_to_id(MARK)]
        return ids, ",".join(map(str, ids)), self.model.decode(ids)

    def words(self, texts: list[str]) -> list[list[tuple[list[int], str, str]]]:
        """The table's entries of each text's words, in place."""
        self.table.tidy()
        look, out = self.table.__getitem__, []
        for text in texts:
            text = text.replace(MARK, " ")
            if not text:
                parts = []
            elif text[0] == " " or text[-1] == " " or "  " in text:
                # runs of marks stay together with the word after them
                parts = [p[1:] for p in CUT.split(" " + text)]
            else:
                parts = text.split(" ")
            out.append(list(map(look, parts)))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(chain.from_iterable(w[0] for w in words)) for words in self.words(texts)]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec per worker process and file."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def sentencepiece_encode(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids): one row per input row; a null text counts as empty, without ids.

    Ids are those of the library, without begin and end ids and without sampling.
    Any id is carried as it is; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, stop in text_blocks(texts):
                ids = work.encode(texts[start:stop])
                yield pa.record_batch(
                    [batch.column(0).slice(start, stop - start), pa.array(ids, pa.list_(pa.int32()))],
                    names=["doc_id", "ids"],
                )

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def sentencepiece_decode(
    encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """(doc_id, text): the library's decode of each row's ids; null ids give ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(model)
        for batch in batches:
            texts = [work.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    return encoded.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>")
    ).mapInArrow(run, "doc_id long, text string")


def sentencepiece_digests(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): a round trip of each text.

    Decoding, too, goes word by word: a word's ids hold all bytes of its characters,
    so the decoded words, joined by the space that each mark is, are the decoded text.
    A null text counts as empty; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, stop in text_blocks(texts):
                found = work.words(texts[start:stop])
                counts = [sum(len(w[0]) for w in words) for words in found]
                ids = [_sha256(",".join([w[1] for w in words])) for words in found]
                decoded = [_sha256(" ".join([w[2] for w in words])) for words in found]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(start, stop - start),
                        pa.array(counts, pa.int64()),
                        pa.array(ids, pa.string()),
                        pa.array(decoded, pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _rows(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
    )
