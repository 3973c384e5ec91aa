"""Registered queries: each operator over whole driver tables.

``queries()`` holds Spark callables ``(spark, sf_dir) -> DataFrame``.  Inputs the
tables lack (request bodies, provider results, chunk streams, vault times) are
derived from them row by row, so every query grows with its tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.entities import canonical_entity, likelihood_score
from veilmark.functions.exprs import inline_rows, where_once
from veilmark.functions.spans import allow_entities, filter_score, select_spans
from veilmark.functions.tokens import find_tokens, make_token, normalize_entity
from veilmark.operators.bodies import (
    extract_texts,
    rebuild_bodies,
    sanitize_requests,
)
from veilmark.operators.chunks import (
    chunk_texts,
    rechunk_batch,
    rehydrate_chunks_batch,
)
from veilmark.operators.detect import (
    detect,
    detect_dictionary,
    detect_regex,
    detect_with,
    findings_long,
    ingest_analyzer_findings,
    ingest_inspect_findings,
)
from veilmark.operators.outbound import detect_chunks, redact_chunks
from veilmark.operators.policy import redact_by_policy
from veilmark.operators.redact import extract_mappings, redact, redact_columns
from veilmark.operators.rehydrate import rehydrate, tokens_long
from veilmark.operators.sessions import redact_sessions, rehydrate_sessions, session_vault
from veilmark.operators.spans_long import select_spans_long
from veilmark.operators.terms import detect_terms
from veilmark.operators.toolcalls import sanitize_tool_calls
from veilmark.operators.vault import (
    detokenize,
    vault_get,
    vault_live,
    vault_purge,
    vault_put,
)
from veilmark.options import Options
from veilmark.plans.jobs import round_trip
from veilmark.sources.tables import (
    CHUNK_SCHEMA,
    compact_vault,
    new_folder,
    read_requests,
    read_vault,
    spread,
    stored,
    stream_chunks,
    write_rejected,
    write_requests,
    write_vault,
)
from veilmark.streaming.jobs import redact_stream, rehydrate_stream
from veilmark.streaming.metrics import detection_events, detection_metrics, rollup_metrics
from veilmark.streaming.rechunk import rechunk_stream
from veilmark.streaming.transactions import restore_transactions

SALT = "salt"
REGEX = Options(salt=SALT, backend="regex")
TERMS = {"quepa": "PERSON", "epau": "LOCATION", "paul": "PERSON", "eauler": "LOCATION"}
NOW = "2026-01-02 12:00:00"
START = "2026-01-01 00:00:00"
INFO_TYPES = {
    "EMAIL_ADDRESS": "EMAIL_ADDRESS",
    "CREDIT_CARD": "CREDIT_CARD_NUMBER",
    "PHONE_NUMBER": "PHONE_NUMBER",
    "IP_ADDRESS": "PASSPORT",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "pages"), "page_id")


def _detect(*entities: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _documents(spark, sf_dir)
        return findings_long(detect_regex(docs, entities=entities), "doc_id")

    return query


def detect_ssn_customers(spark, sf_dir):
    """Numbers built from customer keys; some run on and must not match."""
    key = F.col("c_custkey")
    part = lambda n, width: F.lpad((key % n).cast("string"), width, "0")
    text = F.concat(
        F.lit("no "),
        part(1000, 3),
        F.lit("-"),
        part(100, 2),
        F.lit("-"),
        part(10000, 4),
        F.when(key % 3 == 0, "5 end").when(key % 3 == 1, "é end").otherwise(" end"),
    )
    rows = _table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))
    return findings_long(detect_regex(rows, entities=["US_SSN"]), "c_custkey")


def detect_url_pages(spark, sf_dir):
    pages = _pages(spark, sf_dir).select(
        "page_id", F.concat_ws(" ", "url", "html").alias("text")
    )
    return findings_long(detect_regex(pages, entities=["URL"]), "page_id")


def detect_dictionary_documents(spark, sf_dir):
    found = detect_dictionary(_documents(spark, sf_dir), TERMS)
    return findings_long(found, "doc_id")


def _shouting(texts, language):
    pattern = re.compile("[A-Z]{3,}")
    return [
        [
            {"entity_type": "SHOUT", "start": m.start(), "end": m.end(), "score": 0.75}
            for m in pattern.finditer(t)
        ]
        for t in texts
    ]


def detect_with_custom(spark, sf_dir):
    pages = _pages(spark, sf_dir).select("page_id", "html")
    return findings_long(detect_with(pages, _shouting, "html"), "page_id")


def _crowded(spark, sf_dir) -> DataFrame:
    """Document findings, each with two neighbours: one that begins earlier and
    ends earlier, and one of the same span with a lower score."""
    found = detect_regex(_documents(spark, sf_dir))
    neighbours = F.flatten(
        F.transform(
            "findings",
            lambda f: F.array(
                f,
                F.struct(
                    F.lit("EARLY").alias("entity_type"),
                    (f["start"] - 2).alias("start"),
                    (f["end"] - 3).alias("end"),
                    F.lit(0.7).alias("score"),
                ),
                F.struct(
                    F.lit("WEAK").alias("entity_type"),
                    f["start"].alias("start"),
                    f["end"].alias("end"),
                    F.lit(0.4).alias("score"),
                ),
            ),
        )
    )
    return found.withColumn("findings", neighbours)


def select_spans_documents(spark, sf_dir):
    chosen = _crowded(spark, sf_dir).withColumn(
        "findings", F.expr(select_spans("findings", "length(text)"))
    )
    return findings_long(chosen, "doc_id")


def select_spans_long_documents(spark, sf_dir):
    """The same choice on a table of findings, in ranges of 64 positions."""
    rows = _crowded(spark, sf_dir).select(
        "doc_id", F.length("text").alias("length"), F.posexplode("findings").alias("ord", "finding")
    ).select("doc_id", "length", "ord", "finding.*")
    chosen = select_spans_long(rows, "doc_id", "ord", "length", positions=64)
    return chosen.drop("ord", "length")


def filter_score_documents(spark, sf_dir):
    kept = _crowded(spark, sf_dir).withColumn(
        "findings", F.expr(filter_score("findings", 0.7))
    )
    return findings_long(kept, "doc_id")


def allow_entities_documents(spark, sf_dir):
    kept = _crowded(spark, sf_dir).withColumn(
        "findings", F.expr(allow_entities("findings", ["EARLY", "PHONE_NUMBER"]))
    )
    return findings_long(kept, "doc_id")


def _redacted_documents(spark, sf_dir) -> DataFrame:
    return redact(_documents(spark, sf_dir), REGEX)


def _stored_documents(spark, sf_dir) -> DataFrame:
    redacted = _redacted_documents(spark, sf_dir)
    return stored(redacted.select("doc_id", "text", "mappings"))


def redact_documents(spark, sf_dir):
    return _redacted_documents(spark, sf_dir).select("doc_id", "text", "status")


def redact_dictionary_documents(spark, sf_dir):
    options = Options(salt=SALT, backend="dictionary", terms=TERMS)
    return redact(_documents(spark, sf_dir), options).select("doc_id", "text")


def redact_columns_pages(spark, sf_dir):
    pages = _pages(spark, sf_dir).select("page_id", "url", "html")
    return redact_columns(pages, REGEX, ["url", "html"]).select(
        "page_id", "url", "html"
    )


def make_token_customers(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.expr(make_token("'PERSON'", "c_name", SALT)).alias("token"),
    )


def normalize_entity_parts(spark, sf_dir):
    entity = "if(p_partkey % 10 = 0, '--', concat(' ', lower(p_type), '/', p_name, '!! '))"
    return _table(spark, sf_dir, "part").select(
        "p_partkey", F.expr(normalize_entity(entity)).alias("label")
    )


def extract_mappings_documents(spark, sf_dir):
    return extract_mappings(_redacted_documents(spark, sf_dir))


def _timed_vault(spark, sf_dir) -> DataFrame:
    """One vault row per replaced span, written at an hour given by its document."""
    spans = inline_rows(_redacted_documents(spark, sf_dir), ["doc_id"], "mappings")
    hour = (F.col("doc_id") % 48).cast("int")
    written = F.lit(START).cast("timestamp") + F.make_dt_interval(hours=hour)
    return vault_put(spans, 24 * 3600, written)


def _shown(vault: DataFrame) -> DataFrame:
    moment = "yyyy-MM-dd HH:mm:ss"
    return vault.withColumns(
        {
            "written_at": F.date_format("written_at", moment),
            "expires_at": F.date_format("expires_at", moment),
        }
    )


def vault_put_documents(spark, sf_dir):
    return _shown(_timed_vault(spark, sf_dir))


def vault_live_documents(spark, sf_dir):
    return _shown(vault_live(_timed_vault(spark, sf_dir), NOW))


def vault_purge_documents(spark, sf_dir):
    later = "2026-01-02 20:00:00"
    return _shown(vault_purge(_timed_vault(spark, sf_dir), later))


def _customer_vault(spark, sf_dir) -> DataFrame:
    """Tokens of customer names; every third customer's has expired."""
    names = _table(spark, sf_dir, "customer").select(
        F.expr(make_token("'PERSON'", "c_name", SALT)).alias("token"),
        F.col("c_name").alias("value"),
        F.lit("PERSON").alias("entity_type"),
        "c_custkey",
    )
    written = F.lit(START).cast("timestamp") + F.make_dt_interval(
        hours=F.when(F.col("c_custkey") % 3 == 0, 0).otherwise(24)
    )
    return vault_put(names, 24 * 3600, written)


def _order_tokens(spark, sf_dir) -> DataFrame:
    name = "concat('Customer#', lpad(cast(o_custkey as string), 9, '0'))"
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr(make_token("'PERSON'", name, SALT)).alias("token")
    )


def vault_get_orders(spark, sf_dir):
    return vault_get(
        _order_tokens(spark, sf_dir), _customer_vault(spark, sf_dir), now=NOW
    )


def detokenize_orders(spark, sf_dir):
    return detokenize(
        _order_tokens(spark, sf_dir), _customer_vault(spark, sf_dir), "token", NOW
    )


def detect_terms_orders(spark, sf_dir):
    """All customer names, as a table of terms, in a line of text per order."""
    orders, customer = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    named = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    line = F.concat(F.lit("né "), "c_name", F.lit("/"), "c_name", F.lit(" sent "), "o_orderkey")
    terms = customer.select(F.col("c_name").alias("term"), F.lit("PERSON").alias("entity_type"))
    found = detect_terms(named.select("o_orderkey", line.alias("text")), terms)
    return findings_long(found, "o_orderkey")


def vault_two_writers(spark, sf_dir):
    """Two jobs write batch 0 of one vault, one of them twice: all mappings stay."""
    path = f"{new_folder(spark)}/vault"
    vault = _timed_vault(spark, sf_dir)
    half = F.pmod(F.xxhash64("token"), F.lit(2))
    for writer, part in (("a", 0), ("b", 1), ("b", 1)):
        write_vault(vault.where(half == part), path, writer, 0)
    return _shown(read_vault(spark, path))


def vault_compact_then_write(spark, sf_dir):
    """A compacted vault keeps its rows when a job writes batch 0 afterwards."""
    folder = new_folder(spark)
    vault = _timed_vault(spark, sf_dir)
    write_vault(vault, f"{folder}/old", "job", 0)
    compact_vault(spark, f"{folder}/old", f"{folder}/new", NOW)
    write_vault(vault.where("false"), f"{folder}/new", "job", 0)
    return _shown(read_vault(spark, f"{folder}/new"))


def rehydrate_repeated_keys(spark, sf_dir):
    """Keys that repeat or are null do not mix up rows."""
    redacted = _stored_documents(spark, sf_dir)
    keyed = redacted.select(
        "doc_id", F.when(F.col("doc_id") % 2 > 0, F.col("doc_id") % 5).alias("key"), "text"
    )
    vault = _document_vault(redacted)
    back = rehydrate(keyed, vault, "key", now="2026-01-01 06:00:00")
    return back.select("doc_id", "text")


def find_tokens_documents(spark, sf_dir):
    return tokens_long(_redacted_documents(spark, sf_dir), "doc_id")


def _document_vault(redacted: DataFrame) -> DataFrame:
    return vault_put(extract_mappings(redacted), 24 * 3600, START)


def rehydrate_documents(spark, sf_dir):
    redacted = _stored_documents(spark, sf_dir)
    vault = _document_vault(redacted)
    return rehydrate(
        redacted.select("doc_id", "text"), vault, "doc_id", now="2026-01-01 06:00:00"
    )


def rehydrate_partly_expired(spark, sf_dir):
    """Only e-mail tokens are live; the rest stay as tokens."""
    redacted = _stored_documents(spark, sf_dir)
    hour = F.when(F.col("entity_type") == "EMAIL_ADDRESS", 24).otherwise(0)
    vault = vault_put(
        extract_mappings(redacted),
        24 * 3600,
        F.lit(START).cast("timestamp") + F.make_dt_interval(hours=hour),
    )
    return rehydrate(redacted.select("doc_id", "text"), vault, "doc_id", now=NOW)


def round_trip_documents(spark, sf_dir):
    trip = round_trip(_documents(spark, sf_dir), REGEX, "doc_id")
    return trip.select(
        "doc_id",
        F.length("restored").alias("restored_length"),
        (F.col("original") == F.col("restored")).alias("same"),
    )


def _analyzer_json(spark, sf_dir) -> DataFrame:
    found = detect_regex(_documents(spark, sf_dir))
    # every seventh result is cut short, as a broken response would be
    whole = F.to_json("findings")
    broken = F.substring(whole, F.lit(1), F.length(whole) - 1)
    return found.select(
        "doc_id",
        "text",
        F.when(F.col("doc_id") % 7 == 0, broken).otherwise(whole).alias("result_json"),
    )


def ingest_analyzer(spark, sf_dir):
    ingested = ingest_analyzer_findings(_analyzer_json(spark, sf_dir), "result_json")
    return findings_long(ingested, "doc_id")


def _inspect_json(spark, sf_dir) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in INFO_TYPES.items() for x in pair])
    grades = F.array(
        *[F.lit(x) for x in ("VERY_LIKELY", "LIKELY", "POSSIBLE", "UNLIKELY",
                             "VERY_UNLIKELY", "UNSPECIFIED")]
    )
    found = detect_regex(_documents(spark, sf_dir))
    items = F.transform(
        "findings",
        lambda f: F.struct(
            F.struct(F.try_element_at(names, f["entity_type"]).alias("name")).alias(
                "infoType"
            ),
            F.get(grades, (f["start"] % 6)).alias("likelihood"),
            F.struct(
                F.struct(
                    f["start"].cast("string").alias("start"), f["end"].alias("end")
                ).alias("codepointRange")
            ).alias("location"),
        ),
    )
    return found.select(
        "doc_id",
        "text",
        F.to_json(F.struct(F.struct(items.alias("findings")).alias("result"))).alias(
            "result_json"
        ),
    )


def ingest_inspect(spark, sf_dir):
    ingested = ingest_inspect_findings(
        _inspect_json(spark, sf_dir), "result_json", threshold=0.5
    )
    return findings_long(ingested, "doc_id")


def ingest_inspect_allowlist(spark, sf_dir):
    ingested = ingest_inspect_findings(
        _inspect_json(spark, sf_dir), "result_json", ["CREDIT_CARD", "CRYPTO"]
    )
    return findings_long(ingested, "doc_id")


def canonical_entity_parts(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(
        "p_partkey",
        F.expr(
            """CASE p_size % 3 WHEN 0 THEN 'US_SOCIAL_SECURITY_NUMBER'
               WHEN 1 THEN 'PERSON_NAME' ELSE p_type END AS name"""
        ),
    )
    return rows.select(
        "p_partkey", F.expr(canonical_entity("name")).alias("entity_type")
    )


def likelihood_score_parts(spark, sf_dir):
    names = "array('VERY_LIKELY', 'LIKELY', 'POSSIBLE', 'UNLIKELY', 'VERY_UNLIKELY')"
    return _table(spark, sf_dir, "part").select(
        "p_partkey",
        F.expr(likelihood_score(f"get({names}, p_size % 7)")).alias("score"),
    )


def _fail_policy(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = Options(salt=SALT, on_error=mode)
        done = redact(_analyzer_json(spark, sf_dir), options)
        return done.select("doc_id", "text", "status")

    return query


def _bodies(spark, sf_dir) -> DataFrame:
    """A request body per document, with both content shapes."""
    parts = F.array(
        F.struct(F.lit("text").alias("type"), F.col("lang").alias("text")),
        F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit("text").alias("type"), F.col("text").alias("text")),
    )
    head = F.to_json(
        F.struct(
            F.lit("m").alias("model"),
            F.col("doc_id").alias("seed"),
            F.col("source").alias("system"),
            parts.alias("input"),
        )
    )
    messages = F.to_json(
        F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    )
    # splice "messages" into the object, with a plain string among the messages
    body = F.concat(
        F.substring(head, F.lit(1), F.length(head) - 1),
        F.lit(',"messages":["skip",'),
        F.substring(messages, F.lit(2), F.length(messages)),
        F.lit("}"),
    )
    # every fifth body has text after the object and is not JSON
    return spread(_table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("body_id"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(body, F.lit(" x"))).otherwise(body).alias(
            "body"
        ),
    )


def extract_texts_documents(spark, sf_dir):
    return extract_texts(_bodies(spark, sf_dir))


def extract_texts_conversations(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("body_id"),
        F.to_json(
            F.struct(
                F.array(
                    F.struct(F.col("role"), F.col("text").alias("content"))
                ).alias("messages")
            )
        ).alias("body"),
    )
    return extract_texts(turns)


def _fields_of(bodies: DataFrame, *extra: str) -> DataFrame:
    message = F.get_json_object("body", "$.messages[1].content")
    return bodies.select(
        "body_id",
        *extra,
        F.get_json_object("body", "$.input[2].text").alias("part_text"),
        message.alias("message_text"),
        F.get_json_object("body", "$.seed").alias("seed"),
    )


def sanitize_requests_documents(spark, sf_dir):
    done = sanitize_requests(_bodies(spark, sf_dir), REGEX)
    return _fields_of(done, "status")


def sanitize_requests_custom(spark, sf_dir):
    """A detector of one's own, failing closed; ids are null or repeat."""

    def detector(texts, language):
        if any("É" in t for t in texts):
            raise RuntimeError("cannot inspect")
        return _shouting(texts, language)

    number = F.col("body_id")
    bodies = _bodies(spark, sf_dir).select(
        number.alias("doc_id"),
        F.when(number % 3 > 0, number % 7).alias("body_id"),
        "body",
    )
    done = sanitize_requests(
        bodies, Options(salt=SALT, on_error="closed"), detector=detector
    )
    return done.select(
        "doc_id",
        "body_id",
        "status",
        F.size("mappings").alias("mappings"),
        # the body is still this row's
        F.get_json_object("body", "$.seed").alias("seed"),
    )


def rebuild_bodies_documents(spark, sf_dir):
    bodies = _bodies(spark, sf_dir)
    texts = extract_texts(bodies).where(F.col("path") == "messages")
    shorter = texts.withColumn("text", F.concat(F.lit("<"), F.col("text"), F.lit(">")))
    return _fields_of(rebuild_bodies(bodies, shorter))


def sanitize_prompts(spark, sf_dir):
    """``prompt`` bodies compared byte by byte: with an address, blank, and plain."""
    number = F.col("doc_id")
    text = (
        F.when(number % 3 == 0, F.concat("source", F.lit(" a"), number, F.lit("@b.co")))
        .when(number % 3 == 1, F.lit("   "))
        .otherwise(F.concat(F.lit("né "), "source"))
    )
    body = F.concat(
        F.lit('{ "n" : 1.50, "prompt":"'), text, F.lit('" , "x":12345678901234567890}')
    )
    requests = _table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    return sanitize_requests(requests, REGEX).select("doc_id", "body", "status")


def _findings_by_name(spark, sf_dir, options: Options) -> DataFrame:
    docs = spread(_table(spark, sf_dir, "documents"), "doc_id")
    return findings_long(detect(docs, options), "doc_id")


def detect_by_name_regex(spark, sf_dir):
    return _findings_by_name(spark, sf_dir, REGEX)


def rechunk_small_blocks(spark, sf_dir):
    """Streams of many blocks: no byte is lost, and no block cuts a token."""
    chunks, _ = _document_chunks(spark, sf_dir, 120)
    blocks = rechunk_batch(chunks, 1024)
    tokens = f"size({find_tokens('text')})"
    return (
        _as_text_bytes(blocks)
        .groupBy("stream_id")
        .agg(F.sum("bytes").alias("bytes"), F.sum(F.expr(tokens)).alias("tokens"))
        .where("bytes > 0")
    )


def _as_text_bytes(blocks: DataFrame) -> DataFrame:
    # a block may cut a character, never a token; tokens are ASCII
    text = F.decode("chunk", "ISO-8859-1").alias("text")
    return blocks.select("stream_id", F.octet_length("chunk").alias("bytes"), text)


def _document_chunks(spark, sf_dir, chars: int) -> tuple[DataFrame, DataFrame]:
    redacted = _stored_documents(spark, sf_dir)
    return chunk_texts(redacted, "doc_id", "text", chars), redacted


def _as_text(blocks: DataFrame) -> DataFrame:
    return blocks.select(
        "stream_id", "block", F.decode("chunk", "UTF-8").alias("text")
    )


def rechunk_documents(spark, sf_dir):
    chunks, _ = _document_chunks(spark, sf_dir, 120)
    return _as_text(rechunk_batch(chunks))


def rehydrate_chunks_documents(spark, sf_dir):
    chunks, redacted = _document_chunks(spark, sf_dir, 120)
    return _as_text(
        rehydrate_chunks_batch(chunks, _document_vault(redacted), "2026-01-01 06:00:00")
    )


def _stored_chunks(spark, sf_dir, work: str, chars: int) -> DataFrame:
    """Documents as chunk files, late chunks in other files than early ones."""
    chunks, redacted = _document_chunks(spark, sf_dir, chars)
    (
        chunks.withColumn("ts", F.lit(START).cast("timestamp"))
        .select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in CHUNK_SCHEMA.split(", ")])
        .repartition(F.pmod("seq", F.lit(2)), F.pmod("stream_id", F.lit(16)))
        .write.parquet(f"{work}/chunks")
    )
    return redacted


def rechunk_stream_documents(spark, sf_dir):
    work = new_folder(spark)
    _stored_chunks(spark, sf_dir, work, 300)
    live = stream_chunks(spark, f"{work}/chunks", maxFilesPerTrigger="8")
    (
        rechunk_stream(live, idle_seconds=None)
        .writeStream.format("parquet")
        .option("path", f"{work}/out")
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return _as_text(rechunk_batch(spark.read.parquet(f"{work}/out")))


def rehydrate_stream_documents(spark, sf_dir):
    work = new_folder(spark)
    redacted = _stored_chunks(spark, sf_dir, work, 300)
    write_vault(_document_vault(redacted), f"{work}/vault", "documents", 0)
    live = stream_chunks(spark, f"{work}/chunks", maxFilesPerTrigger="8")
    (
        rehydrate_stream(
            live,
            f"{work}/vault",
            f"{work}/out",
            f"{work}/checkpoint",
            idle_seconds=None,
            now="2026-01-01 06:00:00",
        )
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return _as_text(rechunk_batch(spark.read.parquet(f"{work}/out")))


def _raw_chunks(spark, sf_dir, chars: int) -> DataFrame:
    return chunk_texts(_documents(spark, sf_dir), "doc_id", "text", chars)


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    """One text per stream, its chunks joined in order."""
    piece = F.struct(*order, F.col("chunk").cast("string").alias("chunk"))
    whole = F.array_join(F.array_sort(F.collect_list(piece))["chunk"], "")
    return rows.groupBy("stream_id").agg(whole.alias("text")).where("text <> ''")


def outbound_detect_chunks(spark, sf_dir):
    """Whatever the cut, findings in a stream are those of its whole text."""
    return detect_chunks(_raw_chunks(spark, sf_dir, 37), block_bytes=512)


def outbound_redact_chunks(spark, sf_dir):
    done = redact_chunks(_raw_chunks(spark, sf_dir, 37), REGEX, block_bytes=512)
    return _in_order(done, "block", "part")


def _landed(chunks: DataFrame, path: str, phase: int) -> None:
    columns = [c.split() for c in CHUNK_SCHEMA.split(", ")]
    rows = chunks.withColumn("ts", F.lit(START).cast("timestamp"))
    rows = rows.select(*[F.col(name).cast(kind) for name, kind in columns])
    rows.coalesce(8).write.mode("append").parquet(f"{path}/{phase}")


def _finished(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def _finished_with_data(spark, writer) -> None:
    """``_finished`` without the batch that only follows the watermark: the next run's does it."""
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        _finished(writer)
    finally:
        spark.conf.set(setting, before)


def outbound_redact_stream(spark, sf_dir):
    work = new_folder(spark)
    _landed(_raw_chunks(spark, sf_dir, 200), f"{work}/in", 0)
    live = stream_chunks(spark, f"{work}/in/0", maxFilesPerTrigger="4")
    paths = (f"{work}/vault", f"{work}/out", f"{work}/checkpoint")
    _finished(redact_stream(live, REGEX, *paths, idle_seconds=None))
    return _in_order(spark.read.parquet(f"{work}/out"), "seq")


def late_chunks_documents(spark, sf_dir):
    """Chunks that come after their stream broke off go out as late; none is lost.

    One chunk in five is delayed; two streams in three are reported broken before it comes.
    """
    work = new_folder(spark)
    chunks = _raw_chunks(spark, sf_dir, 300)
    delayed = (F.col("stream_id") + F.col("seq")) % 5 == 3
    broken = _documents(spark, sf_dir).where("doc_id % 3 > 0 and text is not null").select(
        F.col("doc_id").alias("stream_id"),
        F.lit(None).alias("seq"),
        F.lit(None).alias("chunk"),
        F.lit(True).alias("eos"),
    )
    for phase, rows in enumerate((chunks.where(~delayed), broken, chunks.where(delayed))):
        _landed(rows, f"{work}/in", phase)
        live = stream_chunks(spark, f"{work}/in/*")
        _finished(
            rechunk_stream(live, idle_seconds=None)
            .writeStream.format("parquet")
            .option("path", f"{work}/out")
            .option("checkpointLocation", f"{work}/checkpoint")
        )
    out = spark.read.parquet(f"{work}/out")
    late = F.col("reason") == "late"
    emitted = _in_order(out.where(~late), "seq")
    after = _in_order(out.where(late), "seq").withColumnRenamed("text", "late_text")
    return emitted.join(after, "stream_id", "full")


def _session_requests(spark, sf_dir) -> DataFrame:
    """Documents as requests of 50 sessions, an hour apart."""
    hour = F.make_dt_interval(hours=F.col("doc_id").cast("int"))
    return _documents(spark, sf_dir).select(
        "doc_id",
        (F.col("doc_id") % 50).alias("session_id"),
        (F.lit(START).cast("timestamp") + hour).alias("ts"),
        "text",
    )


def _session_salts(requests: DataFrame) -> DataFrame:
    """Three salts a session; the second and third begin 200 and 400 hours after the first."""
    version = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("salt_version")
    begin = F.make_dt_interval(hours=(F.col("salt_version") * 200 + F.col("session_id")).cast("int"))
    return requests.select("session_id").distinct().select("session_id", version).select(
        "session_id",
        "salt_version",
        F.concat(F.lit("s"), "session_id", F.lit("v"), "salt_version").alias("salt"),
        (F.lit(START).cast("timestamp") + begin).alias("valid_from"),
    )


def session_redact(spark, sf_dir):
    requests = _session_requests(spark, sf_dir)
    done = redact_sessions(requests, _session_salts(requests), REGEX)
    return done.select("doc_id", "session_id", "salt_version", "text", "status")


def session_round_trip(spark, sf_dir):
    """Answers repeat the redacted text; every fourth arrives in another session."""
    requests = _session_requests(spark, sf_dir)
    done = stored(redact_sessions(requests, _session_salts(requests), REGEX))
    vault = session_vault(done, 24 * 3600, START)
    moved = F.when(F.col("doc_id") % 4 == 0, F.col("session_id") + 100).otherwise(F.col("session_id"))
    answers = done.select("doc_id", moved.alias("session_id"), "text")
    return rehydrate_sessions(answers, vault, now="2026-01-01 06:00:00")


def _policies(spark, sf_dir) -> DataFrame:
    """Rules by nation for single namespaces, by region for all."""
    pick = lambda key, *values: F.element_at(
        F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int")
    )
    nation = _table(spark, sf_dir, "nation").select(
        F.concat(F.lit("src"), "n_nationkey").alias("namespace"),
        pick("n_nationkey", "", "/v1", "/v1/en", "/v1/de/1/").alias("route"),
        pick("n_nationkey", "*", "EMAIL_ADDRESS", "CREDIT_CARD").alias("entity_type"),
        pick("n_nationkey", "audit", "tokenize", "mask", "block", "mask").alias("action"),
    )
    region = _table(spark, sf_dir, "region").select(
        F.lit("*").alias("namespace"),
        pick("r_regionkey", "", "/v1/en", "/v1/en/1", "/v1/fr", "/v1/en").alias("route"),
        pick("r_regionkey", "*", "EMAIL_ADDRESS", "*", "PHONE_NUMBER", "EMAIL_ADDRESS").alias("entity_type"),
        pick("r_regionkey", "audit", "mask", "block", "tokenize", "tokenize").alias("action"),
    )
    return nation.unionByName(region)


def redact_by_policy_documents(spark, sf_dir):
    requests = spread(_table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id",
        F.col("source").alias("namespace"),
        F.concat(F.lit("/v1/"), "lang", F.lit("/"), F.col("doc_id") % 4).alias("route"),
        "text",
    )
    done = redact_by_policy(requests, _policies(spark, sf_dir), REGEX)
    entry = lambda a: F.concat_ws(":", a["entity_type"], a["action"], a["start"], a["end"])
    return done.select(
        "doc_id",
        "text",
        "status",
        F.size("mappings").alias("mappings"),
        F.array_join(F.transform("audit", entry), ",").alias("audit"),
    )


def transactions_documents(spark, sf_dir):
    """Requests a minute apart and their answers, joined as streams.

    By document: some answers name a request that was never made, some come too late, some
    never.  Rows far in the future move the watermark past all others, and the run after
    theirs gives out what waited for it.
    """
    work = new_folder(spark)
    redacted = stored(_redacted_documents(spark, sf_dir))
    number = F.col("doc_id")
    asked_at = F.lit(START).cast("timestamp") + F.make_dt_interval(mins=number.cast("int"))
    requests = redacted.select(number.alias("request_id"), asked_at.alias("ts"), "mappings")
    chunks = chunk_texts(redacted, "doc_id", "text", 500)
    number, kind = F.col("stream_id"), F.col("stream_id") % 7
    blocks = where_once(rechunk_batch(chunks, 1024).where(kind != 5), "octet_length(chunk) > 0")
    asked_at = F.lit(START).cast("timestamp") + F.make_dt_interval(mins=number.cast("int"))
    after = F.when(kind == 4, 7200).otherwise(60)
    responses = blocks.select(
        F.when(kind == 3, number + 10_000_000).otherwise(number).alias("request_id"),
        F.col("block").alias("seq"),
        "chunk",
        (asked_at + F.make_dt_interval(secs=after)).alias("ts"),
    )
    latest = requests.agg(F.max("ts").alias("ts"))
    live = {}
    for phase in range(3):
        for name, rows in (("requests", requests), ("responses", responses)):
            if phase:
                years = F.make_ym_interval(F.lit(phase))
                rows = rows.limit(0).unionByName(
                    latest.select((F.col("ts") + years).alias("ts")), allowMissingColumns=True
                )
            rows.write.parquet(f"{work}/{name}/{phase}")
            schema = rows.schema
            live[name] = spark.readStream.schema(schema).parquet(f"{work}/{name}/*")
        _finished_with_data(
            spark,
            restore_transactions(live["requests"], live["responses"])
            .writeStream.format("parquet")
            .option("path", f"{work}/out")
            .option("checkpointLocation", f"{work}/checkpoint"),
        )
    out = spark.read.parquet(f"{work}/out").where("request_id is not null")
    piece = F.struct("seq", F.decode("chunk", "ISO-8859-1").alias("chunk"))
    whole = F.array_join(F.array_sort(F.collect_list(piece))["chunk"], "")
    text = F.encode(whole, "ISO-8859-1").cast("string")
    return out.groupBy("request_id", "status").agg(
        F.when(F.count("chunk") > 0, text).alias("text")
    )


def requests_files(spark, sf_dir):
    """Bodies written as Parquet and as lines of text, read back, sanitized and written."""
    work = new_folder(spark)
    bodies = _bodies(spark, sf_dir)
    bodies.write.parquet(f"{work}/table")
    bodies.where("body is not null").select("body").write.text(f"{work}/lines")

    def detector(texts, language):
        if any("É" in t for t in texts):
            raise RuntimeError("cannot inspect")
        return _shouting(texts, language)

    options = Options(salt=SALT, on_error="closed")
    outcome = []
    for kind, name in (("parquet", "table"), ("text", "lines")):
        done = stored(sanitize_requests(read_requests(spark, f"{work}/{name}", kind), options, detector=detector))
        write_requests(done, f"{work}/{name}-out", "job", 0)
        write_rejected(done, f"{work}/{name}-bad", "job", 0)
        # once more: the same batch of the same writer is replaced
        write_requests(done, f"{work}/{name}-out", "job", 0)
        for part in ("out", "bad"):
            rows = spark.read.parquet(f"{work}/{name}-{part}")
            seed = F.get_json_object("body", "$.seed") if part == "out" else F.lit(None)
            outcome.append(
                rows.select(
                    F.lit(f"{name}-{part}").alias("target"), "status", seed.cast("string").alias("seed")
                )
            )
    every = outcome[0]
    for rows in outcome[1:]:
        every = every.unionByName(rows)
    return every


def tool_calls_documents(spark, sf_dir):
    """A tool call per document: plain arguments, JSON in a string, JSON in that again."""
    number = F.col("doc_id")
    held = F.struct("text", F.struct(F.col("source").alias("from")).alias("more"))
    once = F.to_json(held)
    twice = F.to_json(F.struct(F.array(once).alias("items")))
    call = lambda arguments: F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.lit("assistant").alias("role"),
                    F.array(
                        F.struct(F.struct(F.lit("f").alias("name"), arguments.alias("arguments")).alias("function"))
                    ).alias("tool_calls"),
                )
            ).alias("messages"),
            # not a tool's: stays as it is
            F.lit("a@b.com").alias("user"),
        )
    )
    plain = F.to_json(
        F.struct(
            F.lit("tools/call").alias("method"),
            F.struct(held.alias("arguments")).alias("params"),
            F.lit("a@b.com").alias("user"),
        )
    )
    bodies = _table(spark, sf_dir, "documents").select(
        "doc_id", F.when(number % 3 == 0, plain).when(number % 3 == 1, call(once)).otherwise(call(twice)).alias("body")
    )
    done = sanitize_tool_calls(spread(bodies, "doc_id"), REGEX)
    arguments = F.get_json_object("body", "$.messages[0].tool_calls[0].function.arguments")
    number = F.col("doc_id")
    return done.select(
        "doc_id",
        F.when(number % 3 == 0, F.get_json_object("body", "$.params.arguments.text"))
        .when(number % 3 == 1, F.get_json_object(arguments, "$.text"))
        .otherwise(F.get_json_object(F.get_json_object(arguments, "$.items[0]"), "$.text"))
        .alias("text"),
        F.get_json_object("body", "$.user").alias("user"),
        "status",
    )


def _events(spark, sf_dir) -> DataFrame:
    hour = F.make_dt_interval(hours=F.col("doc_id").cast("int"))
    redacted = _redacted_documents(spark, sf_dir).select(
        F.col("doc_id").alias("request_id"), (F.lit(START).cast("timestamp") + hour).alias("ts"), "mappings"
    )
    return detection_events(redacted)


def detection_metrics_documents(spark, sf_dir):
    """Counts by day and type from a live stream in which half of all events come twice."""
    work = new_folder(spark)
    events = stored(_events(spark, sf_dir))
    again = events.where(F.xxhash64("event_id") % 2 == 0)
    latest = events.agg((F.max("ts") + F.make_ym_interval(F.lit(1))).alias("ts"))
    beyond = events.limit(0).unionByName(latest.withColumn("event_id", F.lit("end")), allowMissingColumns=True)
    # an hour per event: days apart is late, so repeats come with the first delivery
    for phase, rows in enumerate((events.unionByName(again), beyond, beyond.withColumn("event_id", F.lit("end2")))):
        rows.write.parquet(f"{work}/in/{phase}")
        live = spark.readStream.schema(events.schema).parquet(f"{work}/in/*")
        _finished(
            detection_metrics(live, "1 day")
            .writeStream.format("parquet")
            .option("path", f"{work}/out")
            .option("checkpointLocation", f"{work}/checkpoint")
        )
    out = spark.read.parquet(f"{work}/out")
    day = F.date_format("window_start", "yyyy-MM-dd").alias("day")
    return out.where("entity_type is not null").select(day, "entity_type", "findings")


def detection_metrics_rollup(spark, sf_dir):
    """Distinct tokens and requests by type from merged sketches, close to the exact numbers."""
    events = stored(_events(spark, sf_dir))
    merged = rollup_metrics(detection_metrics(events, "1 day"), "entity_type")
    exact = events.groupBy("entity_type").agg(
        F.countDistinct("token").alias("tokens"), F.countDistinct("request_id").alias("requests")
    )
    close = lambda found, true: F.abs(F.col(found) - F.col(true)) <= F.col(true) * 0.08
    return merged.join(exact, "entity_type").select(
        "entity_type",
        "findings",
        "tokens",
        "requests",
        close("distinct_tokens", "tokens").alias("tokens_close"),
        close("distinct_requests", "requests").alias("requests_close"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "detect_regex_documents": _detect(),
        "detect_email": _detect("EMAIL_ADDRESS"),
        "detect_credit_card": _detect("CREDIT_CARD"),
        "detect_phone": _detect("PHONE_NUMBER"),
        "detect_ip": _detect("IP_ADDRESS"),
        "detect_allowlist": _detect("EMAIL_ADDRESS", "IP_ADDRESS", "PERSON"),
        "detect_ssn_customers": detect_ssn_customers,
        "detect_url_pages": detect_url_pages,
        "detect_dictionary": detect_dictionary_documents,
        "detect_with_custom": detect_with_custom,
        "ingest_analyzer": ingest_analyzer,
        "ingest_inspect": ingest_inspect,
        "ingest_inspect_allowlist": ingest_inspect_allowlist,
        "canonical_entity": canonical_entity_parts,
        "likelihood_score": likelihood_score_parts,
        "filter_score": filter_score_documents,
        "allow_entities": allow_entities_documents,
        "select_spans": select_spans_documents,
        "select_spans_long": select_spans_long_documents,
        "redact_documents": redact_documents,
        "redact_dictionary": redact_dictionary_documents,
        "redact_columns_pages": redact_columns_pages,
        "make_token": make_token_customers,
        "normalize_entity": normalize_entity_parts,
        "extract_mappings": extract_mappings_documents,
        "vault_put": vault_put_documents,
        "vault_live": vault_live_documents,
        "vault_purge": vault_purge_documents,
        "vault_get": vault_get_orders,
        "detokenize": detokenize_orders,
        "find_tokens": find_tokens_documents,
        "rehydrate_documents": rehydrate_documents,
        "rehydrate_partly_expired": rehydrate_partly_expired,
        "round_trip_documents": round_trip_documents,
        "extract_texts": extract_texts_documents,
        "extract_texts_conversations": extract_texts_conversations,
        "sanitize_requests": sanitize_requests_documents,
        "sanitize_requests_custom": sanitize_requests_custom,
        "rebuild_bodies": rebuild_bodies_documents,
        "fail_policy_open": _fail_policy("open"),
        "fail_policy_closed": _fail_policy("closed"),
        "rechunk_batch": rechunk_documents,
        "rehydrate_chunks_batch": rehydrate_chunks_documents,
        "rechunk_stream": rechunk_stream_documents,
        "rehydrate_stream": rehydrate_stream_documents,
        "detect_terms": detect_terms_orders,
        "detect_by_name_regex": detect_by_name_regex,
        "sanitize_prompts": sanitize_prompts,
        "rechunk_small_blocks": rechunk_small_blocks,
        "vault_two_writers": vault_two_writers,
        "vault_compact_then_write": vault_compact_then_write,
        "rehydrate_repeated_keys": rehydrate_repeated_keys,
        "outbound_detect_chunks": outbound_detect_chunks,
        "outbound_redact_chunks": outbound_redact_chunks,
        "outbound_redact_stream": outbound_redact_stream,
        "late_chunks": late_chunks_documents,
        "transactions": transactions_documents,
        "tool_calls": tool_calls_documents,
        "detection_metrics": detection_metrics_documents,
        "detection_metrics_rollup": detection_metrics_rollup,
        "requests_files": requests_files,
        "session_redact": session_redact,
        "session_round_trip": session_round_trip,
        "redact_by_policy": redact_by_policy_documents,
    }
