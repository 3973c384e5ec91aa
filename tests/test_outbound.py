"""Findings in streams are those of the whole text, however the stream was cut."""

import random

import pytest
from pyspark.sql import functions as F

from veilmark.functions.fixed import RULE_PATTERNS
from veilmark.functions.longtext import redact_string, rule_matcher
from veilmark.operators.outbound import detect_chunks, open_match_at, redact_chunks
from veilmark.options import Options
from veilmark.sources.tables import read_vault, stream_chunks
from veilmark.streaming.jobs import redact_stream
from veilmark.streaming.rechunk import rechunk_stream

OPTIONS = Options(salt="s", backend="regex")
MATCH = rule_matcher(RULE_PATTERNS)
BITS = [
    "4111 1111 1111 1111", "+1 (555) 123 4567", "555 123 4567", "a.b@c.co", "jané@x.com", "1.2.3.4",
    "123-45-6789", "http://x.y/é?q=1", "https:", "//", " ", "  ", "\n", "\t", "\x0b", "é", "🙂", "(", ")",
    "7", "12 34", "word", ".", "[[CMPL_", "@", "中文",
]
SCHEMA = "stream_id bigint, seq bigint, chunk binary, eos boolean"


def random_text(rng, size):
    return "".join(rng.choice(BITS) for _ in range(size))


def test_any_cut_behind_what_is_open_changes_no_finding():
    rng = random.Random(3)
    for _ in range(400):
        text = random_text(rng, 14)
        data = text.encode()
        want = [(text[a:b], e) for a, b, _, e in MATCH(text)]
        for stop in range(len(data) + 1):
            at = open_match_at(data[:stop])
            parts = [data[:at].decode(), data[at:].decode()]
            assert [(p[a:b], e) for p in parts for a, b, _, e in MATCH(p)] == want, (text, stop)


def test_open_match_looks_past_long_runs():
    assert open_match_at(b"ab " + b"x" * 20_000) == 3
    assert open_match_at(b"x" * 20_000) == 0
    assert open_match_at(b"x" * 4095 + b"\n" + b"y" * 4096) == 4096
    assert open_match_at(b"4 4") == 0 and open_match_at(b"4 a") == 2 and open_match_at(b"a 4") == 2


def streams(spark, texts, size):
    rows = []
    for key, text in texts.items():
        data = text if isinstance(text, bytes) else text.encode()
        starts = list(range(0, len(data), size)) or [0]
        rows += [(key, n, data[i : i + size], i + size >= len(data)) for n, i in enumerate(starts)]
    random.Random(size).shuffle(rows)
    return spark.createDataFrame(rows + rows[:5], SCHEMA)


@pytest.mark.parametrize("size,block", [(1, 300), (7, 300), (100, 1000), (5000, 300)])
def test_finished_streams(spark, size, block):
    rng = random.Random(size)
    texts = {k: random_text(rng, rng.randint(0, 300)) for k in range(12)}
    texts[50] = "x" * 2000 + "@b.com " + "4111 " * 100 + "a@" + "b." * 700 + "com"
    found = {}
    for r in detect_chunks(streams(spark, texts, size), None, block).collect():
        found.setdefault(r.stream_id, []).append((r.start, r.end, r.entity_type))
    done = {}
    rows = redact_chunks(streams(spark, texts, size), OPTIONS, block).collect()
    for r in sorted(rows, key=lambda r: (r.stream_id, r.block, r.part)):
        done[r.stream_id] = done.get(r.stream_id, b"") + bytes(r.chunk)
    for key, text in texts.items():
        spans = MATCH(text)
        assert sorted(found.get(key, [])) == sorted((a, b, e) for a, b, _, e in spans)
        assert done.get(key, b"").decode() == redact_string(text, spans, "s")[0]


def test_bytes_that_are_not_text(spark):
    texts = {1: b"mail a@b.com\n\xff\xfe 1.2.3.4\n" + b"tail\n" * 80, 2: b"", 3: b"ok 1.2.3.4"}
    for mode, kept in (("open", True), ("closed", False)):
        options = Options(salt="s", backend="regex", on_error=mode)
        rows = redact_chunks(streams(spark, texts, 5), options, 300).collect()
        odd = [r for r in rows if r.status in ("passed_uninspected", "rejected")]
        assert odd and all((r.chunk is not None) == kept and not r.mappings for r in odd)
        fine = [r for r in rows if r.stream_id == 3]
        assert all(b"1.2.3.4" not in bytes(r.chunk) for r in fine)
    assert redact_chunks(spark.createDataFrame([], SCHEMA), OPTIONS, 300).count() == 0


def test_other_backends_are_refused(spark):
    with pytest.raises(ValueError):
        redact_chunks(spark.createDataFrame([], SCHEMA), Options(salt="s"), 300)


def land(spark, rows, path, phase):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{path}/{phase}")


def run(writer):
    assert writer.trigger(availableNow=True).start().awaitTermination(180)


@pytest.mark.parametrize("size", [1, 11])
def test_live_streams(spark, work, size):
    rng = random.Random(5)
    texts = {k: random_text(rng, 40) for k in range(5)}
    rows = [tuple(r) for r in streams(spark, texts, size).collect()]
    for phase in range(2):
        land(spark, rows[phase::2], f"{work}/in", phase)
        live = stream_chunks(spark, f"{work}/in/*")
        run(redact_stream(live, OPTIONS, f"{work}/vault", f"{work}/out", f"{work}/cp", None))
    out, values = {}, {r.value for r in read_vault(spark, f"{work}/vault").collect()}
    for r in sorted(spark.read.parquet(f"{work}/out").collect(), key=lambda r: (r.stream_id, r.seq)):
        out[r.stream_id] = out.get(r.stream_id, b"") + bytes(r.chunk)
    for key, text in texts.items():
        want, mappings = redact_string(text, MATCH(text), "s")
        assert out.get(key, b"").decode() == want
        assert {m["value"] for m in mappings} <= values


def test_nothing_is_lost_under_any_delay(spark, work):
    """Random orders, repeats, breaks: emitted and late bytes are the input's, each once."""
    rng = random.Random(9)
    texts = {k: random_text(rng, 30).encode() for k in range(30)}
    rows = []
    for key, data in texts.items():
        starts = list(range(0, len(data), 4)) or [0]
        rows += [(key, n, data[i : i + 4], i + 4 >= len(data)) for n, i in enumerate(starts)]
    phases = [[], [], [], []]
    for row in rows:
        phases[rng.choice([0, 0, 0, 1, 2, 3])].append(row)
        if rng.random() < 0.1:
            phases[3].append(row)
    phases[1] += [(k, None, None, True) for k in range(0, 30, 2)]
    for phase, part in enumerate(phases):
        rng.shuffle(part)
        land(spark, part, f"{work}/in", phase)
        live = rechunk_stream(stream_chunks(spark, f"{work}/in/*"), None)
        run(live.writeStream.format("parquet").option("path", f"{work}/out")
            .option("checkpointLocation", f"{work}/cp"))
    out = spark.read.parquet(f"{work}/out").collect()
    assert {r.reason for r in out} >= {"late", "timeout", "eos"}
    for key, data in texts.items():
        mine = [r for r in out if r.stream_id == key]
        late = {r.seq: bytes(r.chunk) for r in mine if r.reason == "late"}
        emitted = b"".join(bytes(r.chunk) for r in sorted(mine, key=lambda r: r.seq) if r.reason != "late")
        gone = {n: data[4 * n : 4 * n + 4] for n in late}
        assert late == gone
        rest = b"".join(data[i : i + 4] for i in range(0, len(data), 4) if i // 4 not in late)
        assert emitted == rest
