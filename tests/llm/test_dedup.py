"""Exact and fingerprint duplicates against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import AWKWARD, documents
from veilmark.llm.components import components
from veilmark.llm.exact_dedup import exact_dedup
from veilmark.llm.simhash_dedup import near_pairs, simhash_dedup


def content(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(content(t), []).append((i, len(t or "")))
    out = []
    for i, t in rows:
        group = groups[content(t)]
        named = [(-n, k) for k, n in group if k is not None]
        keep = min(named)[1] if named else None
        digest = hashlib.sha256(content(t).encode()).hexdigest()
        out.append((i, keep, len(group), i == keep, digest))
    return sorted(out, key=repr)


def exact_rows(frame):
    frame = frame.withColumn("digest", F.lower(F.hex("digest")))
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_exact_awkward(awkward):
    assert exact_rows(exact_dedup(awkward)) == brute_exact(AWKWARD)


def test_exact_whole_table(spark, sample):
    assert exact_rows(exact_dedup(documents(spark, sample))) == brute_exact(sample)


def test_exact_one_text_holds_most_rows(spark):
    rows = [(k, "same text" + " " * (k % 3)) for k in range(3000)]
    rows += [(k, f"other {k}") for k in range(3000, 4000)]
    assert exact_rows(exact_dedup(documents(spark, rows))) == brute_exact(rows)


def test_exact_digests_may_collide(spark, sample):
    weak = exact_dedup(
        documents(spark, sample), digest=lambda c: F.crc32(c.cast("binary")) % 5
    )
    got = sorted(tuple(r)[:4] for r in weak.collect())
    assert got == sorted(r[:4] for r in brute_exact(sample))


def test_exact_nothing(no_documents):
    assert exact_dedup(no_documents).collect() == []


def shingle_bits(text, words_each=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < words_each:
        shingles = [b" ".join(words)]
    else:
        shingles = [
            b" ".join(words[k : k + words_each]) for k in range(len(words) - words_each + 1)
        ]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(
        (2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)
    )


def brute_near(rows, bits=2):
    prints = [(i, shingle_bits(t)) for i, t in rows]
    values = sorted({f for _, f in prints})
    name = {v: v for v in values}

    def root(v):
        while name[v] != v:
            v = name[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= bits:
                name[root(b)] = root(a)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return sorted(((i, f, least.get(root(f))) for i, f in prints), key=repr)


def near_rows(frame):
    rows = frame.select("doc_id", "fp", "component_id").collect()
    return sorted(((r[0], r[1] & (1 << 64) - 1, r[2]) for r in rows), key=repr)


def test_near_awkward(awkward):
    short = [(i, t if t is None else t[:2000]) for i, t in AWKWARD]
    frame = awkward.withColumn("text", F.substring("text", 1, 2000))
    assert near_rows(simhash_dedup(frame)) == brute_near(short)


def test_near_long_text_is_read_whole(spark):
    words = " ".join(str(k % 977) for k in range(70_000))
    got = simhash_dedup(documents(spark, [(1, words)])).first()["fp"]
    assert got & (1 << 64) - 1 == shingle_bits(words)


def test_near_whole_table(spark, sample):
    short = [(i, t) for i, t in sample if len(t or "") < 4000]
    assert near_rows(simhash_dedup(documents(spark, short))) == brute_near(short)


def test_near_nothing(no_documents):
    assert simhash_dedup(no_documents).collect() == []


@pytest.mark.parametrize("segments", [8, 12, 15])
def test_pairs_are_complete(spark, segments):
    rng = random.Random(segments)
    values = {0, (1 << 64) - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(6):
            flipped = base
            for _ in range(rng.randint(1, 4)):
                flipped ^= 1 << rng.randrange(64)
            values.add(flipped)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    frame = spark.createDataFrame(signed, "fp long")
    got = {tuple(sorted(r)) for r in near_pairs(frame, 2, segments).collect()}
    want = {
        tuple(sorted((a[0], b[0])))
        for a in signed
        for b in signed
        if a < b and ((a[0] ^ b[0]) & (1 << 64) - 1).bit_count() <= 2
    }
    assert got == want


def test_components_of_chains_stars_and_cycles(spark):
    links = [(k, k + 1) for k in range(0, 60)]
    links += [(500, k) for k in range(100, 140)]
    links += [(200 + k, 200 + (k + 1) % 7) for k in range(7)]
    links += [(900, 900), (None, 3), (901, 900), (901, 900)]
    rng = random.Random(3)
    rng.shuffle(links)
    got = dict(components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
    want = {k: 0 for k in range(61)} | {k: 100 for k in [*range(100, 140), 500]}
    want |= {k: 200 for k in range(200, 207)} | {900: 900, 901: 900}
    assert got == want
