import time

import pytest
from pyspark.sql import functions as F

from veilmark.functions.longtext import token
from veilmark.operators.chunks import rechunk_batch, rehydrate_chunks_batch
from veilmark.options import Options
from veilmark.plans.jobs import sanitize_job
from veilmark.sources.tables import read_vault, stream_chunks, stream_requests, write_vault
from veilmark.streaming.jobs import rehydrate_stream, sanitize_stream
from veilmark.streaming.rechunk import open_token_at, rechunk_stream

T0, T1, T2 = "2026-01-01 00:00:00", "2026-01-01 01:00:00", "2026-01-01 02:00:00"
JANE, MAIL = token("PERSON", "Jane Doe", "s"), token("EMAIL_ADDRESS", "jané@x.com", "s")
GHOST = token("PERSON", "Ghost", "s")
PAYLOADS = {
    1: f"Signed: {JANE}; more below.",
    2: f'event: x\ndata: ["{JANE}","{MAIL}"]\n\n',
    3: f"x {GHOST} y",
    4: "matrix [[a]] and [[3;4]] stay",
    5: f"é🙂{MAIL}{JANE}[[CM",
    6: "[[CMPL_" + "A" * 200 + f" {JANE}[[CMPL_",
}


def restored(text):
    return text.replace(JANE, "Jane Doe").replace(MAIL, "jané@x.com")


def vault(spark):
    rows = [(JANE, "Jane Doe"), (MAIL, "jané@x.com")]
    df = spark.createDataFrame(rows, "token string, value string")
    return df.select("token", "value", F.lit("P").alias("entity_type"),
                     F.lit(T0).cast("timestamp").alias("written_at"),
                     F.lit(T2).cast("timestamp").alias("expires_at"))


def cut(payloads, size, offset=0):
    rows = []
    for sid, text in payloads.items():
        data = text.encode()
        starts = list(range(0, len(data), size)) or [0]
        rows += [(sid + offset, n, data[i : i + size], i + size >= len(data))
                 for n, i in enumerate(starts)]
    return rows


SCHEMA = "stream_id bigint, seq bigint, chunk binary, eos boolean"


def joined(df, order):
    streams = {}
    for r in sorted(df.collect(), key=lambda r: (r.stream_id, r[order])):
        streams[r.stream_id] = streams.get(r.stream_id, b"") + bytes(r.chunk)
    return streams


def test_open_token_at():
    for data, at in [
        (b"abc", 3),
        (b"abc[", 3),
        (b"abc[[CM", 3),
        (b"x[[CMPL_PERSON_12", 1),
        (b"x[[CMPL_PERSON_0123456789abcdef]", 1),
        # none of these can become a token any more
        (b"x[[CMPL_PERSON_0123456789abcdef]]", 33),
        (b"[[CMPL_ hello", 13),
        (b"[[CMPL_x", 8),
        (b"[[CMPL_X]] a", 12),
        (b"[[CMPL_X]] a[[", 12),
        (b"[[CMPL_A[[CMPL_B", 8),
        (b"[[[", 1),
        (b"[[CMPL_" + b"A" * 119, 0),
        (b"[[CMPL_" + b"A" * 120, 127),
    ]:
        assert open_token_at(data) == at, data


def test_longest_token_is_held_back_at_every_cut():
    whole = token("L" * 300, "v", "s").encode()
    assert len(whole) == 128
    for cut in range(1, len(whole)):
        assert open_token_at(b"[[ " + whole[:cut]) == 3



@pytest.mark.parametrize("block", [300, 4096])
def test_batch_restores_every_chunk_size(spark, block):
    payloads = {k: "pad " * 60 + v + " tail" * 70 + v for k, v in PAYLOADS.items()}
    rows = []
    sizes = (1, 2, 3, 5, 7, 16, 39, 64, 500, 5000)
    for i, size in enumerate(sizes):
        rows += cut(payloads, size, offset=1000 * i)
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.union(df.where("seq % 5 = 0"))  # repeated deliveries
    out = joined(rehydrate_chunks_batch(df, vault(spark), T1, block, seq_range=50), "block")
    for i in range(len(sizes)):
        for sid, text in payloads.items():
            assert out[sid + 1000 * i].decode() == restored(text), (sizes[i], sid)


def test_blocks_depend_on_bytes_not_chunks(spark):
    payloads = {1: (f"text {JANE} " * 200)}
    first = rechunk_batch(spark.createDataFrame(cut(payloads, 3), SCHEMA), 1000)
    second = rechunk_batch(spark.createDataFrame(cut(payloads, 777), SCHEMA), 1000)
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))
    assert first.count() > 5


def test_chunks_without_a_place_fail_the_job(spark):
    for row in [(None, 0, b"x", False), (1, None, b"x", False)]:
        with pytest.raises(Exception, match="no stream_id or seq"):
            rechunk_batch(spark.createDataFrame([row, (2, 0, b"y", True)], SCHEMA), 1000).collect()


def stored(spark, rows, path, parts):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.lit(T0).cast("timestamp"))
    for remainder in range(parts):
        # later sequence numbers may come first
        df.where(F.pmod("seq", F.lit(parts)) == parts - 1 - remainder).coalesce(1).write.mode("append").parquet(path)


def run(writer):
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(120), "did not finish"


def test_stream_restores_out_of_order_chunks_across_batches(spark, work):
    rows = []
    for i, size in enumerate((1, 4, 9, 1000)):
        rows += cut(PAYLOADS, size, offset=1000 * i)
    stored(spark, rows, f"{work}/in", 3)
    write_vault(vault(spark), f"{work}/vault", "t", 0)
    live = stream_chunks(spark, f"{work}/in", maxFilesPerTrigger="1")
    run(rehydrate_stream(live, f"{work}/vault", f"{work}/out", f"{work}/cp", None, now=T1))
    out = joined(spark.read.parquet(f"{work}/out"), "seq")
    for i in range(4):
        for sid, text in PAYLOADS.items():
            assert out[sid + 1000 * i].decode() == restored(text)


def test_stream_continues_from_its_checkpoint(spark, work):
    rows = cut(PAYLOADS, 6)
    write_vault(vault(spark), f"{work}/vault", "t", 0)
    for half in (0, 1):
        part = [r for r in rows if (r[1] >= 3) == bool(half)]
        stored(spark, part, f"{work}/in", 1)
        live = stream_chunks(spark, f"{work}/in")
        run(rehydrate_stream(live, f"{work}/vault", f"{work}/out", f"{work}/cp", None, now=T1))
    out = joined(spark.read.parquet(f"{work}/out"), "seq")
    assert {k: v.decode() for k, v in out.items()} == {k: restored(v) for k, v in PAYLOADS.items()}


def test_silent_stream_is_flushed(spark, work):
    rows = [(1, 0, b"ab[[CM", False), (1, 2, b"late", False)]
    stored(spark, rows, f"{work}/in", 1)
    query = (
        rechunk_stream(stream_chunks(spark, f"{work}/in"), idle_seconds=1)
        .writeStream.format("memory").queryName("flushed").outputMode("append")
        .option("checkpointLocation", f"{work}/cp").start()
    )
    deadline = time.time() + 60
    while time.time() < deadline:
        got = spark.table("flushed").collect()
        if len(got) == 2:
            break
        time.sleep(0.5)
    query.stop()
    assert [(bytes(r.chunk), r.reason) for r in sorted(got, key=lambda r: r.eos)] == [
        (b"ab", "chunk"), (b"[[CMlate", "timeout")]


def test_sanitize_stream_and_job(spark, work):
    bodies = [(1, '{"prompt":"mail a@b.com"}'), (2, "nope"), (3, '{"prompt":"1.2.3.4"}')]
    df = spark.createDataFrame(bodies, "body_id bigint, body string")
    df.write.parquet(f"{work}/in")
    options = Options(salt="s", backend="regex")
    run(sanitize_stream(stream_requests(spark, f"{work}/in"), options, f"{work}/vault",
                        f"{work}/out", f"{work}/cp"))
    sanitize_job(df, options, f"{work}/vault", f"{work}/out2", writer_id="job", batch_id=7)
    for path in ("out", "out2"):
        out = {r.body_id: r.body for r in spark.read.parquet(f"{work}/{path}").collect()}
        assert out[2] == "nope" and "a@b.com" not in out[1] and len(out) == 3
    assert {r.value for r in read_vault(spark, f"{work}/vault").collect()} == {"a@b.com", "1.2.3.4"}
    assert read_vault(spark, f"{work}/vault").count() == 4


def test_streams_that_share_a_vault_keep_each_others_mappings(spark, work):
    options = Options(salt="s", backend="regex")
    for k, mail in enumerate(("a@b.com", "c@d.com", "e@f.com")):
        df = spark.createDataFrame([(1, f'{{"prompt":"{mail}"}}')], "body_id bigint, body string")
        df.write.parquet(f"{work}/in{k}")
        # the third is a new checkpoint over the second's output
        run(sanitize_stream(stream_requests(spark, f"{work}/in{k}"), options, f"{work}/vault",
                            f"{work}/out{min(k, 1)}", f"{work}/cp{k}"))
    values = {r.value for r in read_vault(spark, f"{work}/vault").collect()}
    assert values == {"a@b.com", "c@d.com", "e@f.com"}
    assert spark.read.parquet(f"{work}/out1").count() == 2


def test_chunks_delivered_again_after_the_end_are_ignored(spark, work):
    rows = [(1, 0, b"ab", False), (1, 1, b"cd", True)]
    for part in (rows, rows, rows[1:]):
        stored(spark, part, f"{work}/in", 1)
        live = stream_chunks(spark, f"{work}/in")
        query = rechunk_stream(live, None).writeStream.format("parquet").outputMode("append")
        run(query.option("path", f"{work}/out").option("checkpointLocation", f"{work}/cp"))
    out = spark.read.parquet(f"{work}/out").orderBy("seq").collect()
    assert [bytes(r.chunk) for r in out] == [b"ab", b"cd"]


def test_closed_policy_keeps_rejected_bodies_apart(spark, work):
    def detector(texts, language):
        raise RuntimeError("no")

    df = spark.createDataFrame([(1, '{"prompt":"x"}'), (2, "nope")], "body_id bigint, body string")
    sanitize_job(df, Options(salt="s", on_error="closed"), f"{work}/v", f"{work}/out",
                 f"{work}/bad", writer_id="w", batch_id=0, detector=detector)
    assert [r.body_id for r in spark.read.parquet(f"{work}/out").collect()] == [2]
    bad = spark.read.parquet(f"{work}/bad")
    assert [r.body_id for r in bad.collect()] == [1] and "body" not in bad.columns
