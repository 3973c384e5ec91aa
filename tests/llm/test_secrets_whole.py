"""Keys of one case or of digits are tested, and so is what stands beside a base span."""

import random
import string

import pytest

from tests.llm.conftest import documents
from veilmark.llm.secret_scan import (
    base_spans,
    candidates,
    mask_secrets,
    secret_spans,
    word_null,
)

MIXED = string.ascii_letters + string.digits
WORDS = "the name of this thing is written as " * 20


def keys(alphabet, length, count=30):
    rng = random.Random(5)
    return ["".join(rng.choice(alphabet) for _ in range(length)) for _ in range(count)]


@pytest.mark.parametrize(
    ("alphabet", "length"),
    [(string.ascii_lowercase, 48), (string.ascii_uppercase, 64)],
)
def test_keys_of_one_kind(spark, alphabet, length):
    rows = [(k, f"{WORDS} {x} end") for k, x in enumerate(keys(alphabet, length))]
    start = len(WORDS) + 1
    found = secret_spans(documents(spark, rows)).collect()
    got = [r for r in found if [tuple(s) for s in r["spans"]] == [(start, 3, start + length)]]
    assert len(got) >= 27


def test_written_out_runs_are_no_keys(spark):
    runs = [
        "abcdefghijklmnopqrstuvwxyz", "12345678901234567890", "20240101120000000000",
        "thisisaverylongnameofathing", "INTERNATIONALIZATIONS", "Internationalization",
        "2024-01-01-2024-12-31-10-00", "-" * 60, "=" * 60, "0" * 30,
    ]
    rows = [(k, f"{WORDS} {x} end") for k, x in enumerate(runs)]
    rows += [(100 + k, f"{WORDS} {x} end") for k, x in enumerate(keys(MIXED, 40))]
    got = {r["doc_id"]: r["spans"] for r in secret_spans(documents(spark, rows)).collect()}
    assert [runs[k] for k in range(len(runs)) if got[k]] == []
    assert all(got[100 + k] for k in range(30))


def test_digits_are_candidates():
    # 32 digits and more are a hexadecimal base span
    text = "no " + "31415926535897932384626433" + " and " + "-" * 40
    assert list(candidates(text, base_spans(text))) == [(3, 29)]


def test_second_secret_of_a_run(spark):
    access = ["AKIA" + x for x in keys(string.ascii_uppercase + string.digits, 16)]
    digests = keys("0123456789abcdef", 32)
    mixed = keys(MIXED, 40)
    rows = [(k, f"{a}/{m} end") for k, (a, m) in enumerate(zip(access, mixed, strict=True))]
    rows += [(100 + k, f"{d}_{m} end") for k, (d, m) in enumerate(zip(digests, mixed[::-1], strict=True))]
    docs = documents(spark, rows)
    masked = {r["doc_id"]: r["text"] for r in mask_secrets(docs).collect()}
    assert all(m not in text for m in mixed for text in masked.values())
    for r in secret_spans(docs).collect():
        kinds = [s["kind"] for s in r["spans"]]
        assert kinds == [1 if r["doc_id"] < 100 else 2, 3]
        ends = [(s["start"], s["stop"]) for s in r["spans"]]
        assert ends[0][1] == ends[1][0]
    assert word_null(docs).p_value(mixed[0]) < 1e-3


def test_parts_beside_base_spans_against_every_span():
    """The walk side by side gives what comparing each run with all spans gives."""
    import random

    from veilmark.llm.secret_scan import CANDIDATE, LEAST, candidates

    def all_against_all(text, base):
        for match in CANDIDATE.finditer(text):
            at, end = match.span()
            for a, b in [*sorted((a, b) for a, _, b in base), (end, end)]:
                if b < at or a > end:
                    continue
                if a - at >= LEAST and any(map(str.isalnum, text[at:a])):
                    yield at, a
                at = max(at, b)

    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("abAB01/+  =_") * rng.randint(1, 12) for _ in range(60))
        base = sorted((a, rng.randint(0, 2), a + rng.randint(1, 60)) for a in (rng.randint(0, len(text)) for _ in range(rng.randint(0, 9))))
        assert list(candidates(text, base)) == list(all_against_all(text, base))


def test_a_long_list_of_hashes_takes_time_in_proportion():
    import hashlib
    import time

    from veilmark.llm.secret_scan import base_spans, candidates

    text = "\n".join(hashlib.sha256(str(k).encode()).hexdigest() for k in range(150_000))
    started = time.perf_counter()
    base = base_spans(text)
    assert len(base) == 150_000 and list(candidates(text, base)) == []
    assert time.perf_counter() - started < 5
