"""What the transactions query computes, and how often."""

import os

from veilmark.functions.exprs import where_once
from veilmark.operators.chunks import rechunk_batch, with_offsets
from veilmark.plans import queries


def chunks(spark, work):
    rows = [(s, n, f"stream {s} chunk {n} ".encode() * 20, n == 2) for s in range(3) for n in range(3)]
    table = spark.createDataFrame(rows, "stream_id bigint, seq bigint, chunk binary, eos boolean")
    table.write.parquet(f"{work}/chunks")
    return spark.read.parquet(f"{work}/chunks")


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_sizes_are_summed_once(spark, work):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = plan(with_offsets(chunks(spark, work)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert "ReusedExchange" in found


def test_blocks_are_cut_once(spark, work):
    blocks = rechunk_batch(chunks(spark, work), 300)
    kept = where_once(blocks, "octet_length(chunk) > 0")
    assert plan(kept).count("regexp_extract_all") == plan(blocks).count("regexp_extract_all")
    assert kept.count() == blocks.where("octet_length(chunk) > 0").count() > 0


def test_transactions_take_one_batch_a_run(spark, work, monkeypatch):
    rows = [(n, f"mail a{n}@b.com") for n in range(14)] + [(14, None), (15, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{work}/documents.parquet")
    made = []

    def folder(session):
        made.append(f"{work}/run")
        return made[-1]

    monkeypatch.setattr(queries, "new_folder", folder)
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    out = {(r.request_id, r.status): r.text for r in queries.transactions_documents(spark, str(work)).collect()}
    assert spark.conf.get(setting) == before
    assert len([f for f in os.listdir(f"{made[0]}/checkpoint/commits") if f.isdigit()]) == 3
    assert {r for r, s in out if s == "no_response"} == {3, 4, 5, 10, 11, 12, 14, 15}
    assert {r % 10_000_000 for r, s in out if s == "no_request"} == {3, 4, 10, 11}
    assert {r: t for (r, s), t in out.items() if s == "restored"} == {
        n: f"mail a{n}@b.com" for n in (0, 1, 2, 6, 7, 8, 9, 13)
    }
