"""Redaction: text to text with tokens, plus the mappings to put them back.

A redaction is a projection: no shuffle, no join.  Rows fail the gate cheaply,
ordinary rows stay in JVM expressions, and only very long or very dense rows go
through Arrow (see ``functions.longtext``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import longtext
from veilmark.functions.dictionary import any_term, dictionary_findings
from veilmark.functions.exprs import FINDINGS, MAPPINGS, empty, inline_rows, text_literal
from veilmark.functions.fixed import DICTIONARY_SCORE
from veilmark.functions.rules import gate, rule_findings, rule_names
from veilmark.functions.spans import redact_text, unchanged
from veilmark.functions.tokens import SaltColumn
from veilmark.operators.detect import BatchDetector, check_backend, detect
from veilmark.options import Options


class TextRules:
    """A detector that needs nothing but the text: rules or a dictionary.

    Holds the three forms one detector takes: gate and findings as SQL text, and
    a string function for long rows.
    """

    def __init__(self, options: Options):
        if check_backend(options) == "dictionary":
            allowed = set(options.entities)
            terms = {
                t: e for t, e in options.terms.items() if not allowed or e in allowed
            }
            self.native = len(terms) <= longtext.REGEX_TERMS
            if not self.native:  # every row goes through the string function
                self.gate = lambda text: f"{text} IS NOT NULL"
                self.findings = lambda text: empty(FINDINGS)
                self.match = longtext.term_matcher(terms, DICTIONARY_SCORE)
                return
            self.gate = lambda text: any_term(text, terms)
            self.findings = lambda text: dictionary_findings(text, terms)
            self.match = longtext.term_matcher(terms, DICTIONARY_SCORE)
        else:
            rules = rule_names(options.entities)
            self.native = True
            self.gate = lambda text: gate(text, rules)
            self.findings = lambda text: rule_findings(text, rules)
            self.match = longtext.rule_matcher(rules)


def reads_text_only(options: Options) -> bool:
    return options.backend in ("regex", "dictionary")


def redacted(
    text: str, options: Options, long_text_bytes: int = longtext.LONG_TEXT_BYTES
) -> Column:
    """``struct(text, mappings)`` for a text-only detector, as one column."""
    rules = TextRules(options)
    suspicious = rules.gate(text)
    limit = long_text_bytes if rules.native else -1
    short = f"octet_length({text}) <= {limit}"
    in_arrow = F.expr(f"CASE WHEN NOT {short} AND {suspicious} THEN {text} END")
    native = redact_text(text, rules.findings(text), options.salt)
    return (
        F.when(F.expr(f"{short} AND {suspicious}"), F.expr(native))
        .when(
            F.expr(f"NOT {short} AND {suspicious}"),
            longtext.redact_matched_udf(rules.match, options.salt)(in_arrow),
        )
        .otherwise(F.expr(unchanged(text)))
    )


def redacted_native(text: str, options: Options) -> str:
    """The expression path alone, as SQL text; also fit for array lambdas."""
    rules = TextRules(options)
    native = redact_text(text, rules.findings(text), options.salt)
    return f"CASE WHEN {rules.gate(text)} THEN {native} ELSE {unchanged(text)} END"


def redact_findings(
    df: DataFrame, salt: str, text: str = "text", findings: str = "findings"
) -> DataFrame:
    """Redact with the findings already in the table; adds ``redacted``.

    ``salt`` is plain text, or a ``SaltColumn`` where each row has its own."""
    work = f"cast(octet_length({text}) as bigint) * coalesce(size({findings}), 0)"
    dense = f"{work} > {longtext.DENSE_WORK}"
    by_arrow = longtext.redact_found_udf()(
        F.expr(f"CASE WHEN {dense} THEN {text} END"),
        F.expr(f"CASE WHEN {dense} THEN {findings} END"),
        F.expr(salt if isinstance(salt, SaltColumn) else text_literal(salt)),
    )
    result = (
        F.when(F.expr(dense), by_arrow)
        .when(
            F.expr(f"size({findings}) > 0"), F.expr(redact_text(text, findings, salt))
        )
        .otherwise(F.expr(unchanged(text)))
    )
    return df.withColumn("redacted", result)


def redact(
    df: DataFrame,
    options: Options,
    text: str = "text",
    detector: BatchDetector | None = None,
) -> DataFrame:
    """Replace the findings of ``text`` by tokens.

    Adds ``mappings`` (one entry per replaced span), ``detect_error`` and
    ``status``: ``redacted``, ``unchanged``, or, where detection failed,
    ``passed_uninspected`` (``on_error='open'``: text kept as it was) or
    ``rejected`` (``'closed'``: text null).
    """
    if detector is None and reads_text_only(options):
        out = df.withColumns(
            {
                "redacted": redacted(text, options),
                "detect_error": F.lit(None).cast("string"),
            }
        )
    else:
        out = redact_findings(
            detect(df, options, text, detector), options.salt, text
        ).drop("findings")
    return apply_fail_policy(out, options, text)


def apply_fail_policy(df: DataFrame, options: Options, text: str) -> DataFrame:
    failed = F.col("detect_error").isNotNull() & F.col(text).isNotNull()
    if options.on_error == "closed":
        kept, status = F.lit(None).cast("string"), "rejected"
    else:
        kept, status = F.col(text), "passed_uninspected"
    return df.withColumns(
        {
            text: F.when(failed, kept).otherwise(F.col("redacted.text")),
            "mappings": F.when(failed, F.expr(empty(MAPPINGS))).otherwise(
                F.col("redacted.mappings")
            ),
            "status": F.when(failed, status)
            .when(F.size("redacted.mappings") > 0, "redacted")
            .otherwise("unchanged"),
        }
    ).drop("redacted")


def redact_columns(
    df: DataFrame, options: Options, columns: Iterable[str], mappings: str = "mappings"
) -> DataFrame:
    """Redact several text columns of a row; their mappings go into one array.

    Only for backends that read nothing but the text: results of the others belong
    to one column each, so those columns go through ``redact`` one by one.
    """
    if not reads_text_only(options):
        raise ValueError("redact_columns needs the regex or the dictionary backend")
    columns = list(columns)
    staged = df.withColumns(
        {f"_redacted_{c}": redacted(c, options) for c in columns}
    )
    return staged.withColumns(
        {
            **{c: F.col(f"_redacted_{c}.text") for c in columns},
            mappings: F.concat(*[F.col(f"_redacted_{c}.mappings") for c in columns]),
        }
    ).drop(*[f"_redacted_{c}" for c in columns])


def extract_mappings(df: DataFrame, mappings: str = "mappings") -> DataFrame:
    """One row per distinct mapping.

    A plain distinct: repeats are merged inside each task first, so a value
    found in a third of all rows reaches the shuffle once per task.
    """
    return inline_rows(df, [], mappings).distinct()
