"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.conftest import SF
from veilmark.llm.prefix_trie import NodeTable, PerfectHash, end_digests, rebuilt_paths, trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, node string, depth string, words string"


def framed(role, text):
    digest = f"{len(role.encode())}:{role}{text}".encode()
    return hashlib.sha256(digest).digest()[:16]


def expected(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, framed(*t[1:])))
    full = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        rest = abs(conv) % 20 * (1 if conv > 0 else -1)
        head = own.get(conv - rest, [])[:h]
        full[conv] = tuple(t[1:] for t in head + turns[h:])
    members = defaultdict(list)
    for conv, path in full.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved = (len(members[node]) - 1) * words + sum(sums[k][1] for k in kids[node])
        sums[node] = (sum(sums[k][0] for k in kids[node]) or 1, saved)
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if full[c] == node)))
        above = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(node), above, len(convs), len(kids[node]), *sums[node], digest))
    return sorted(map(repr, out))


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return sorted(repr(tuple(r)) for r in trie(rebuilt_paths(frame), **options).select(*COLUMNS).collect())


def random_rows(seed, convs, texts, longest):
    rng = random.Random(seed)
    rows = []
    for _ in range(convs):
        conv = rng.randint(-50, 400)
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([t, t, t, None])
            rows.append((conv, turn, rng.choice(["user", None, "a"]), rng.choice(texts)))
    return rows


AWKWARD = [
    (None, 0, "user", "no id"), (0, 0, "user", "a b"), (0, 0, "user", "a b"), (0, None, None, None),
    (5, 1, "user", "x " * 100_000), (5, 2, "", "\t\n"), (-7, 3, "user", "neg é 中"), (40, -1, "user", ""),
]


@pytest.mark.parametrize("shard_rows", [None, 3, 40])
def test_random_conversations(spark, shard_rows):
    rows = random_rows(1, 150, ["hello there", "a b  c", "", None, "one"], 7)
    assert found(spark, rows, shard_rows=shard_rows) == expected(rows)


def test_awkward_rows(spark):
    assert found(spark, AWKWARD) == expected(AWKWARD)
    assert found(spark, AWKWARD[-1:]) == expected(AWKWARD[-1:])
    assert found(spark, AWKWARD[:1]) == [] == found(spark, [])


def test_copies_of_one_conversation_and_a_hot_first_turn(spark):
    rows = [(c, t, "user", f"turn {t} here") for c in range(0, 4000, 20) for t in range(3)]
    rows += [(c, t, "user", "hot" if t == 0 else f"{c} {t}") for c in range(4000, 9000, 20) for t in range(3)]
    assert found(spark, rows, shard_rows=20) == expected(rows)


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = sorted(repr(tuple(r)) for r in trie(rebuilt_paths(table)).select(*COLUMNS).collect())
    assert got == expected(rows)


def test_ends_of_one_node_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr("veilmark.llm.prefix_trie.BLOB", 50)
    ids = list(range(-300, 3000))
    frame = spark.createDataFrame([(bytes([k % 2]) * 16, i) for i in ids for k in (i,)], "node binary, conv_id long")
    want = {
        bytes([k]) * 16: hashlib.sha256(",".join(str(i) for i in ids if i % 2 == k).encode()).hexdigest()
        for k in (0, 1)
    }
    assert {bytes(r[0]): r[1] for r in end_digests(frame).collect()} == want


@pytest.mark.parametrize("count", [0, 1, 2, 1000, 50_000])
def test_slots_are_minimal_and_perfect(count):
    keys = np.random.default_rng(count).integers(0, 1 << 63, (count, 2)).astype(np.uint64)
    assert sorted(PerfectHash(keys).slots(keys)) == list(range(count))


def test_strangers_are_not_found():
    node = [bytes([k]) * 16 for k in range(1, 200)]
    table = NodeTable(node, [bytes(16)] + node[:-1], range(199), range(199), [2] * 199, [1] * 199, [0] * 199)
    strangers = np.random.default_rng(1).integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    assert (table.find(strangers) == -1).all()
    with pytest.raises(ValueError):
        NodeTable(node[:1] * 2, node[:2], [1, 1], [1, 1], [1, 1], [1, 1], [0, 0])
