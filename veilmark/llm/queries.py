"""The registered queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import embedding_dedup as vectors
from veilmark.llm import (
    conversation_repair,
    exact_dedup,
    html_extract,
    language_id,
    packing,
    prefix_trie,
    secret_scan,
    sentencepiece_codec,
    sequence_files,
    simhash_dedup,
    token_count,
    toxicity,
)
from veilmark.llm.common import path_of, table
from veilmark.llm.oracle import oracle_sql  # noqa: F401

BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out()
    model = language_id.train(docs.where(~out))
    return language_id.identify(docs, model, "doc_id", out.alias("held_out"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_codec.sentencepiece_digests(docs, path_of(PIECES))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(table(spark, sf_dir, "documents"))
    counts = [
        F.expr(f"size(filter(base, x -> x.kind = {k}))").cast("long").alias(f"n_{name}")
        for k, name in enumerate(secret_scan.KINDS[:3])
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.expr(secret_scan.written("base")), 256).alias("base_sha256"),
        F.expr(secret_scan.written("spans")).alias("spans"),
    )


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_count.token_counts(docs, path_of(BPE)).withColumn(
        "over_limit", F.col("n_tokens") > 1024
    )


def op8_sequence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sequence_files.sequence_files(spark, docs, path_of(BPE)).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.simhash_dedup(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, path_of(BPE)).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversation_repair.damaged(turns))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.held_out()
    sample = toxicity.training_passages(docs.where(~out), table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, toxicity.train(sample), "doc_id", out.alias("held_out"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = prefix_trie.rebuilt_paths(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(paths).drop("node")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_language_id,
            op2_embedding_dedup,
            op3_exact_dedup,
            op4_sentencepiece,
            op5_secret_scan,
            op6_html_extract,
            op7_token_count,
            op8_sequence_files,
            op9_simhash_dedup,
            op10_packing,
            op11_conversation_repair,
            op12_toxicity,
            op13_prefix_trie,
            pipeline,
        )
    }
