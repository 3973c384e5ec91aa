"""The pipeline's stages, and the registered queries against SQL and brute force."""

import duckdb
import pytest

import corpus_pipeline
from tests.llm.conftest import SF
from veilmark.llm import queries


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql(spark, duck, name):
    frame = queries.queries()[name](spark, SF)
    result = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(map(repr, result.fetchall()))
    assert sorted(repr(tuple(r)) for r in frame.select(*columns).collect()) == want


CONTRACT = {
    "op1": ["doc_id", "held_out", "lang_pred", "score"],
    "op2": ["vec_id", "n_links", "component_id", "kept"],
    "op3": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op4": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op6": ["page_id", "url", "text", "n_chars"],
    "op7": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op8": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op9": ["doc_id", "fingerprint", "component_id"],
    "op10": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op11": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    "op12": ["doc_id", "held_out", "score", "predicted"],
    "op13": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
}


@pytest.mark.parametrize("name", [n for n in queries.queries() if n != "pipeline"])
def test_columns_and_rows(spark, name):
    frame = queries.queries()[name](spark, SF)
    assert frame.columns == CONTRACT[name.partition("_")[0]]
    table = {"op2": "embeddings", "op6": "pages"}.get(name.partition("_")[0], "documents")
    count = frame.count()
    if name.startswith(("op11", "op13")):
        rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
        # one row per conversation, or per node of all their prefixes
        assert count == rows if name.startswith("op11") else count > rows
        return
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert count >= rows if name.startswith("op10") else count == rows


def test_each_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    awkward = spark.createDataFrame(
        [
            (10**6, None, "en", "s", 0), (10**6 + 1, "12 34", "en", "s", 5),
            (10**6 + 2, "of the and that which", None, None, None), (None, "of the and by", "en", "s", 1),
            (10**6 + 3, "api_key = 'abcdefgh12345678' of the and", "en", "s", 1),
        ],
        docs.schema,
    )
    kept = docs.unionByName(awkward)
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = corpus_pipeline.stored(stage(spark, kept, SF), name)
        if name != "packing":
            assert kept.columns == docs.columns
            ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        if name == "language_id":
            assert before.count() - kept.count() == 2
            assert not ids & {10**6, 10**6 + 1} and {10**6 + 2, None} <= ids
        if name == "exact_dedup":
            texts = ["".join((r[0] or "").split()) for r in kept.select("text").collect()]
            assert len(set(texts)) == len(texts) < before.count()
        if name == "secret_scan":
            text = kept.where(f"doc_id = {10**6 + 3}").first()["text"]
            assert text == "<SECRET>' of the and" and kept.count() == before.count()
    assert {r["doc_id"] for r in kept.select("doc_id").distinct().collect()} == ids


def test_no_rows_go_through(spark):
    kept = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.stored(stage(spark, kept, SF), name)
    assert kept.collect() == []
