"""Chat request bodies: extract text fields, redact them, rebuild the bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions import bodypatch, longtext
from veilmark.functions.chatbody import FIELDS, parsed_fields
from veilmark.functions.exprs import MAPPINGS, bind, empty, inline_rows, text_literal
from veilmark.operators.detect import BatchDetector, batch_findings
from veilmark.operators.redact import TextRules, reads_text_only, redacted_native
from veilmark.options import Options


def _with_fields(df: DataFrame, body: str) -> DataFrame:
    """Add ``_fields``; bodies the VARIANT parser refuses go through Python."""
    staged = df.withColumn("_native", F.expr(parsed_fields(body)))
    refused = F.col("_native").isNull() & F.col(body).isNotNull()
    by_python = bodypatch.fields_udf()(F.when(refused, F.col(body)))
    return staged.withColumn(
        "_fields",
        F.when(refused, by_python)
        .otherwise(F.coalesce("_native", F.expr(empty(FIELDS))))
        .cast(FIELDS),
    ).drop("_native")


def extract_texts(
    requests: DataFrame, body_id: str = "body_id", body: str = "body"
) -> DataFrame:
    """One row per text field: body id, path, pos, part_pos, text."""
    return inline_rows(_with_fields(requests, body), [body_id], "_fields")


def rebuild_bodies(
    requests: DataFrame,
    texts: DataFrame,
    body_id: str = "body_id",
    body: str = "body",
) -> DataFrame:
    """Write new texts (shape of :func:`extract_texts`) back into the bodies.

    Pass only changed texts: bodies without any keep their exact bytes and do
    not reach Python.  The texts of one body are grouped; a body bounds its group.
    ``body_id`` must tell bodies apart: a new text whose id is null, or belongs to
    several different bodies, fails the job, because it could land in another's body.
    """
    new_id = F.when(
        F.col(body_id).isNull(), F.raise_error(F.lit("a new text has no body id"))
    ).otherwise(F.col(body_id))
    texts = texts.withColumn(body_id, new_id)
    grouped = texts.groupBy(body_id).agg(
        F.collect_list(F.struct("path", "pos", "part_pos", "text")).alias("_new")
    )
    digest = F.sha2(F.col(body).cast("binary"), 256)
    several = (
        requests.groupBy(body_id)
        .agg(F.min(digest).alias("_least"), F.max(digest).alias("_most"))
        .where("_least <> _most")
        .select(body_id, F.lit(True).alias("_several"))
    )
    joined = requests.join(grouped.join(several, body_id, "left"), body_id, "left")
    touched = F.col("_new").isNotNull() & F.when(
        F.col("_several"), F.raise_error(F.lit("new texts for an id of several bodies"))
        .cast("boolean")
    ).otherwise(F.lit(True))
    rebuilt = bodypatch.rebuild_udf()(F.when(touched, F.col(body)), F.col("_new"))
    return joined.withColumn(
        body, F.when(touched, rebuilt).otherwise(F.col(body))
    ).select(*requests.columns)


def sanitize_requests(
    requests: DataFrame,
    options: Options,
    body: str = "body",
    detector: BatchDetector | None = None,
    long_body_bytes: int = longtext.LONG_TEXT_BYTES,
) -> DataFrame:
    """Redact every text field of every body.

    Adds ``mappings``, ``detect_error`` and ``status`` (see ``redact``).  With a
    detector that reads only text this is one projection without a shuffle:
    raw gate, VARIANT walk and redaction in expressions, and Arrow only for the
    bodies that change.  A detector of your own gets the text fields of some
    bodies, about a megabyte, at a time.  Either way a body never leaves its row: ids are not read.
    """
    if detector is not None:
        return _sanitize_by_detector(requests, options, body, detector)
    if not reads_text_only(options):
        raise ValueError(
            f"backend {options.backend!r} has results per text, not per body: use "
            "extract_texts, redact and rebuild_bodies, or pass a detector"
        )

    rules = TextRules(options)
    if not rules.native:
        long_body_bytes = -1
    # JSON escapes can hide from the raw gate what it looks for: the characters
    # rules need only as a code point or an escaped slash, a term's by any escape.
    escapes = ["\\"] if options.backend == "dictionary" else ["\\u", "\\/"]
    hidden = " OR ".join(f"contains({body}, {text_literal(e)})" for e in escapes)
    suspicious = f"coalesce({rules.gate(body)} OR {hidden}, false)"
    parsable = f"CASE WHEN {suspicious} AND octet_length({body}) <= {long_body_bytes} THEN {body} END"

    staged = (
        requests.withColumn("_fields", F.expr(bind(parsable, "raw", parsed_fields("raw"))))
        .withColumn(
            "_results",
            F.expr(f"transform(_fields, fd -> {redacted_native('fd.text', options)})"),
        )
        .withColumn(
            "_mappings", F.expr("flatten(transform(_results, r -> r.mappings))")
        )
    )
    # null _fields: too long, or not parsed by the expressions
    by_python = f"(_fields IS NULL AND {suspicious})"
    changed = "coalesce(size(_mappings) > 0, false)"
    patched = bodypatch.patch_udf(rules.match, options.salt)(
        F.expr(f"CASE WHEN {changed} OR {by_python} THEN {body} END"),
        F.expr(f"CASE WHEN {changed} THEN transform(_fields, fd -> fd.text) END"),
        F.expr(f"CASE WHEN {changed} THEN transform(_results, r -> r.text) END"),
    )
    return _with_policy(staged.withColumn("_patched", patched), options, body)


def _sanitize_by_detector(
    requests: DataFrame, options: Options, body: str, detector: BatchDetector
) -> DataFrame:
    """Everything happens in the row: fields, findings and the new body.

    No key and no shuffle, so null or repeated ids cannot mix bodies up.
    """
    find = batch_findings(detector, options.language)
    allowed = set(options.entities or ())

    def spans(texts: list[str]) -> list[tuple]:
        return [
            (
                [
                    (f["start"], f["end"], f["score"], f["entity_type"])
                    for f in found or ()
                    if not allowed or f["entity_type"] in allowed
                ],
                error,
            )
            for found, error in find(texts)
        ]

    done = bodypatch.detect_udf(spans, options.salt)(F.col(body))
    staged = requests.withColumns(
        {"_patched": done, "_mappings": F.lit(None).cast(MAPPINGS)}
    )
    return _with_policy(staged, options, body)


def _with_policy(staged: DataFrame, options: Options, body: str) -> DataFrame:
    """Body, mappings and status from ``_patched``, which may carry an error."""
    failed = F.col("_patched.error").isNotNull()
    if options.on_error == "closed":
        kept, status = F.lit(None).cast("string"), "rejected"
    else:
        kept, status = F.col(body), "passed_uninspected"
    none = F.expr(empty(MAPPINGS))
    found = F.coalesce("_patched.mappings", "_mappings", none)
    return (
        staged.withColumn("mappings", F.when(failed, none).otherwise(found))
        .withColumns(
            {
                body: F.when(failed, kept).otherwise(F.coalesce("_patched.body", body)),
                "detect_error": F.col("_patched.error"),
                "status": F.when(failed, status)
                .when(F.size("mappings") > 0, "redacted")
                .otherwise("unchanged"),
            }
        )
        .drop("_fields", "_results", "_mappings", "_patched")
    )
