"""Encoders, counts, files and packing against the tokenizer libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import AWKWARD, documents
from veilmark.llm.bpe_chunks import ChunkEncoder, Memory
from veilmark.llm.common import new_path, path_of
from veilmark.llm.packing import Limits, Packer, pack_documents, pack_examples
from veilmark.llm.sentencepiece_codec import (
    PieceCodec,
    sentencepiece_decode,
    sentencepiece_digests,
    sentencepiece_encode,
)
from veilmark.llm.sequence_files import (
    ShardReader,
    read_documents,
    sequence_files,
    write_sequences,
)
from veilmark.llm.token_count import TokenCounter, token_counts

BPE = path_of("byte_bpe_50k.json")
PIECE = path_of("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(BPE)
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECE)

BITS = [
    "a", "the", " word", "'s", "'", "'re", "'r", "'l", "'ll", "'ve", "'v", "1", "23", " ",
    "  ", "\n", "\t", "é", "ß", "中", "▁", "<|endoftext|>", "!", "..", "\x0b", "\x1c", "\x85",
    "　", "🙂", "́", "\r\n", "²", "\x00", "﻿", "====", "        ", "aaaa", "ing",
    "<s>", "<0x0A>", "<unk>",
]
TEXTS = st.lists(st.one_of(st.sampled_from(BITS), st.text(max_size=5)), max_size=20).map("".join)
ENCODER, CODEC = ChunkEncoder(BPE, kept=50), PieceCodec(PIECE, kept=50)
COUNTER = TokenCounter(BPE, chunk=8)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_chunks_give_the_librarys_ids(texts):
    assert [x.tolist() for x in ENCODER.encode(texts)] == [library_ids(t) for t in texts]


def test_texts_with_and_without_cuts_keep_their_order():
    texts = [
        "plain words. here", "two  spaces\t tab", "", " ", "end.\nNext line", "a \nb c\n d",
        " first", "x\n\nY z.\nW", "é.\nÉté ß\u00a0 nb", "a\x1c b\u3000 c", "<|endoftext|> q.\nr",
        "q <|endoftext|>\nNext w.\n<|endoftext|>", "last plain one", "trailing ", "\nline first",
    ]
    for block in (texts, texts[::-1], texts[1:2], texts[:1], []):
        assert [x.tolist() for x in ENCODER.encode(block)] == [library_ids(t) for t in block]


class CountingMemory(Memory):
    asked = 0

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)

    def get(self, key, default=None):
        self.asked += 1
        return super().get(key, default)


def test_a_block_asks_once_for_each_different_chunk():
    work = ChunkEncoder(BPE)
    work.chunks = CountingMemory(work._chunk, 1000)
    texts = ["one two three, " * 500 + "end"] * 20
    assert [x.tolist() for x in work.encode(texts)] == [library_ids(t) for t in texts]
    assert work.chunks.asked <= 10


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_words_give_the_librarys_pieces_and_texts(texts):
    words = CODEC.words(texts)
    assert [[i for w in ws for i in w[0]] for ws in words] == MODEL.encode(texts)
    assert [" ".join(w[2] for w in ws) for ws in words] == [MODEL.decode(MODEL.encode(t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_transducers_count_the_librarys_tokens(texts):
    assert COUNTER.count(texts).tolist() == [len(library_ids(t)) for t in texts]


def test_counts_of_long_runs():
    rng = random.Random(5)
    texts = [
        "a" * 5000, "\n" * 3000 + "x", " " * 1001, "-" * 777 + "=", "x" * 33 + "y" * 2000,
        "".join(rng.choice("abcxyz") for _ in range(9000)),
    ]
    assert COUNTER.count(texts).tolist() == [len(library_ids(t)) for t in texts]


def test_counts_after_the_table_was_emptied():
    small = TokenCounter(BPE)
    small.pieces.max_states = 50
    texts = ["some words here", "Überraschung und anderes", "otros textos más"]
    for text in texts * 3:
        assert small.count([text]).tolist() == [len(library_ids(text))]


def test_token_counts(awkward, no_documents):
    got = sorted((tuple(r) for r in token_counts(awkward, BPE).collect()), key=repr)
    want = [(i, len((t or "").encode()), len(library_ids(t))) for i, t in AWKWARD]
    assert got == sorted(want, key=repr)
    assert token_counts(no_documents, BPE).collect() == []


def test_sentencepiece(awkward, no_documents):
    encoded = sentencepiece_encode(awkward, PIECE)
    want = [(i, MODEL.encode(t or "")) for i, t in AWKWARD]
    got = [(r[0], list(r[1])) for r in encoded.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    texts = [tuple(r) for r in sentencepiece_decode(encoded, PIECE).collect()]
    assert sorted(texts, key=repr) == sorted(((i, MODEL.decode(x)) for i, x in want), key=repr)
    counts = [(r[0], r[1]) for r in sentencepiece_digests(awkward, PIECE).collect()]
    assert sorted(counts, key=repr) == sorted(((i, len(x)) for i, x in want), key=repr)
    assert sentencepiece_encode(no_documents, PIECE).collect() == []


def test_sequence_files(spark, sample, no_documents):
    rows = sample + [(None, "no id"), (3, "again"), (10**12, None)]
    frame = documents(spark, rows).repartition(5)
    got = [tuple(r) for r in sequence_files(spark, frame, BPE, 2).collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for i, t in order:
        ids = np.array([*library_ids(t), 2], "<u4")
        want.append((i, start, len(ids), ids.tobytes()))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert sequence_files(spark, no_documents, BPE, 2).collect() == []


def test_sequences_are_equally_long_and_masked(spark):
    rows = [(k, "word " * (k * 7 % 50)) for k in range(60)]
    index = write_sequences(
        documents(spark, rows), BPE, new_path(spark, "seq"), 2, length=16, batch_rows=4
    )
    total = 0
    for file in {r["file"] for r in index.collect()}:
        reader = ShardReader(file)
        count = sum(reader.file.get_batch(k).num_rows for k in range(reader.file.num_record_batches))
        for k in range(count):
            ids, mask = reader.sequence(k)
            assert len(ids) == len(mask) == 16
            assert mask.all() or k == count - 1
            assert not mask.all() or (ids == reader.ids(16 * k, 16)).all()
            total += int(mask.sum())
    assert total == sum(r["n_tokens"] for r in index.collect())
    assert isinstance(reader.file.schema.field("ids").type, pa.FixedSizeListType)
    assert read_documents(index).count() == 60


def check_packing(pieces, wanted, limit=2048):
    """pieces: (key, start, length, sequence, offset); wanted: ids of each key."""
    seen = {}
    for key, start, length, *_ in pieces:
        seen.setdefault(key, []).append((start, length))
    for key, total in wanted.items():
        at = 0
        for start, length in sorted(seen.pop(key, [])):
            assert start == at and length > 0
            at += length
        assert at == total
    assert not seen
    sequences = {}
    for _, _, length, sequence, offset in pieces:
        sequences.setdefault(sequence, []).append((offset, length))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding


def test_packer_leaves_no_padding():
    rng = random.Random(1)
    sizes = {k: rng.choice([1, 3, 40, 700, 2048, 5000]) + rng.randint(0, 20) for k in range(3000)}
    packer, pieces = Packer(Limits()), []
    for key, size in sizes.items():
        pieces += packer.add(key, size)
    pieces += packer.finish()
    assert check_packing(pieces, sizes) == 0


@pytest.mark.parametrize("limits", [Limits(64, 3, 20), Limits(32, 32, 32), Limits(16, 1, 5)])
def test_packer_keeps_all_limits(limits):
    rng = random.Random(2)
    packer, pieces, flags = Packer(limits, pool=20), [], {}
    for key in range(300):
        flags[key] = np.array([rng.random() < 0.4 for _ in range(rng.randint(0, 90))], int)
        pieces += packer.add(key, len(flags[key]), np.append(0, np.cumsum(flags[key])))
    pieces += packer.finish()
    check_packing(pieces, {k: len(f) for k, f in flags.items() if len(f)}, limits.tokens)
    need = {}
    for key, start, length, sequence, _ in pieces:
        n = need.setdefault(sequence, [0, 0, 0])
        n[0] += length
        n[1] += 1
        n[2] += int(flags[key][start : start + length].sum())
    for tokens, segments, loss in need.values():
        assert tokens <= limits.tokens and segments <= limits.segments
        assert loss <= limits.loss_tokens


def test_pack_documents(spark, no_documents):
    named = [(k, t) for k, (_, t) in enumerate(AWKWARD)]
    rows = pack_documents(documents(spark, named).repartition(3), BPE).collect()
    ids = {k: [*library_ids(t), 1] for k, t in named}
    for r in rows:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids"] == part.tobytes() and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(r["ids"]) == zlib.crc32(part.tobytes())
    pieces = [(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in rows]
    check_packing(pieces, {k: len(x) for k, x in ids.items()})
    assert pack_documents(no_documents, BPE).collect() == []
    # null and repeated ids are carried
    awkward = pack_documents(documents(spark, AWKWARD), BPE)
    assert awkward.agg({"length": "sum"}).first()[0] == sum(map(len, ids.values()))


def test_pack_examples(spark):
    rows = [(k, [j % 3 == 0 for j in range(k % 40)]) for k in range(200)] + [(999, None), (1000, [None, True])]
    frame = spark.createDataFrame(rows, "id long, loss_mask array<boolean>")
    got = [tuple(r) for r in pack_examples(frame, Limits(64, 4, 20)).collect()]
    check_packing(got, {k: len(m) for k, m in rows if m}, 64)
    with pytest.raises(ValueError):
        pack_examples(frame, Limits(0, 1, 1))


@pytest.mark.parametrize("shortest,longest", [(1, 1), (1, 5), (3, 10), (8, 15), (1, 3000)])
def test_short_documents_are_packed_without_padding(shortest, longest):
    rng = random.Random(longest)
    packer = Packer(Limits(segments=2048))
    sizes = [rng.randint(shortest, longest) for _ in range(20_000)]
    placed = [p for k, n in enumerate(sizes) for p in packer.add(k, n)]
    held = len(packer.docs) + len(packer.fresh)
    placed += packer.finish()
    filled = {}
    for _, _, count, sequence, _ in placed:
        filled[sequence] = filled.get(sequence, 0) + count
    room = sum(n if n & (n - 1) == 0 else 2048 for n in filled.values())
    assert sum(filled.values()) == sum(sizes) >= 0.99 * room
    assert held <= 2048 + 1024 and max(filled.values()) <= 2048
