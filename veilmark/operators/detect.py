"""Detection: DataFrame with text to findings.

Every detector adds ``findings`` (array of structs, offsets in code points) and
``detect_error`` (null unless the row could not be inspected).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import longtext
from veilmark.functions.chatbody import get
from veilmark.functions.dictionary import any_term, gated_dictionary
from veilmark.functions.entities import (
    canonical_entity,
    flexible_int,
    likelihood_score,
)
from veilmark.functions.fixed import DICTIONARY_SCORE
from veilmark.functions.exprs import FINDINGS, bind, empty, inline_rows, struct
from veilmark.functions.rules import gate, gated_findings, rule_names
from veilmark.functions.spans import allow_entities, filter_score
from veilmark.operators.terms import detect_terms
from veilmark.options import Options


def _with_findings(df: DataFrame, findings: str) -> DataFrame:
    return df.withColumns(
        {"findings": F.expr(findings), "detect_error": F.lit(None).cast("string")}
    )


def detect_regex(
    df: DataFrame, text: str = "text", entities: Iterable[str] | None = None
) -> DataFrame:
    """Built-in rules; the threshold does not apply (every score is 1.0)."""
    rules = rule_names(entities)
    return _by_length(
        df, text, gated_findings(text, entities), gate(text, rules), longtext.rule_matcher(rules)
    )


def _by_length(
    df: DataFrame,
    text: str,
    findings: str,
    suspicious: str,
    match: Callable[[str], list[longtext.Span]],
) -> DataFrame:
    """Expressions for ordinary texts; long ones that pass the gate go through Arrow,
    where many matches cost time in proportion to their number."""
    long = f"octet_length({text}) > {longtext.DETECT_BYTES} AND {suspicious}"
    by_arrow = longtext.find_matched_udf(match)(F.expr(f"CASE WHEN {long} THEN {text} END"))
    found = F.when(F.expr(long), by_arrow).otherwise(F.expr(findings))
    return df.withColumns({"findings": found, "detect_error": F.lit(None).cast("string")})


def detect_dictionary(
    df: DataFrame,
    terms: Mapping[str, str],
    text: str = "text",
    entities: Iterable[str] | None = None,
) -> DataFrame:
    """Every occurrence of the given terms (term -> entity type).  More terms than a regex
    can try one after the other are found by ``detect_terms``."""
    allowed = set(entities or ())
    kept = {t: e for t, e in terms.items() if not allowed or e in allowed}
    if len(kept) > longtext.REGEX_TERMS:
        rows = [t for t in kept.items() if t[0]]
        return detect_terms(
            df, df.sparkSession.createDataFrame(rows, "term string, entity_type string"), text
        )
    return _by_length(
        df,
        text,
        gated_dictionary(text, kept),
        any_term(text, kept),
        longtext.term_matcher(kept, DICTIONARY_SCORE),
    )


def _fine(v: str, test: str) -> str:
    """A field is fine when absent, JSON null, or of the right type."""
    return bind(v, "fld", f"fld IS NULL OR is_variant_null(fld) OR {test}")


def _is(kind: str) -> str:
    return f"schema_of_variant(fld) = '{kind}'"


_OBJECT = "startswith(schema_of_variant(fld), 'OBJECT')"
_WHOLE = f"({_is('BIGINT')} AND {get('fld', '$', 'int')} IS NOT NULL)"
_NUMBER = "rlike(schema_of_variant(fld), '^(BIGINT|DOUBLE|DECIMAL|FLOAT)')"
_RESULT = f"struct<findings:{FINDINGS},error:string>"


def _failed(note: str) -> str:
    return f"cast({struct(findings='null', error=repr(note))} as {_RESULT})"


def _nothing() -> str:
    return f"cast({struct(findings=empty(FINDINGS), error='null')} as {_RESULT})"


def _checked(items: str, ok: str, finding: str, note: str) -> str:
    """Findings of ``items`` if every ``item`` is ok, else an error."""
    read = struct(ok=f"coalesce({ok}, false)", finding=finding)
    done = struct(findings="transform(rows, row -> row.finding)", error="null")
    return bind(
        f"transform({items}, item -> {read})",
        "rows",
        f"if(forall(rows, row -> row.ok), cast({done} as {_RESULT}), {_failed(note)})",
    )


def analyzer_findings(json: str) -> str:
    """struct(findings, error) of one analyzer result array (SQL text).

    The threshold is the analyzer's business and is not applied again here.
    """
    note = "analyzer result: not an array of findings"
    ok = " AND ".join(
        [
            _fine("item", _OBJECT),
            _fine(get("item", "$.entity_type"), _is("STRING")),
            _fine(get("item", "$.start"), _WHOLE),
            _fine(get("item", "$.end"), _WHOLE),
            _fine(get("item", "$.score"), _NUMBER),
        ]
    )
    finding = struct(
        entity_type=f"coalesce({get('item', '$.entity_type', 'string')}, '')",
        start=f"coalesce({get('item', '$.start', 'int')}, 0)",
        end=f"coalesce({get('item', '$.end', 'int')}, 0)",
        score=f"coalesce({get('item', '$.score', 'double')}, 0D)",
    )
    return bind(
        f"try_parse_json({json})",
        "res",
        f"""CASE WHEN is_variant_null(res) THEN {_nothing()}
            WHEN {get('res', '$', 'array<variant>')} IS NOT NULL
            THEN {_checked(get('res', '$', 'array<variant>'), ok, finding, note)}
            ELSE {_failed(note)} END""",
    )


def inspect_findings(json: str) -> str:
    """struct(findings, error) of one inspect result (SQL text).

    No findings is fine.
    """
    note = "inspect result: not a result object"

    def offset(key: str) -> str:
        path = f"$.location.codepointRange.{key}"
        text = bind(
            get("item", path),
            "off",
            f"""CASE WHEN off IS NULL OR is_variant_null(off) THEN ''
                WHEN schema_of_variant(off) IN ('STRING', 'BIGINT')
                THEN {get('off', '$', 'string')} ELSE '?' END""",
        )
        return bind(text, "num", flexible_int("num"))

    ok = " AND ".join(
        [
            _fine("item", _OBJECT),
            _fine(get("item", "$.infoType"), _OBJECT),
            _fine(get("item", "$.location"), _OBJECT),
            _fine(get("item", "$.location.codepointRange"), _OBJECT),
            _fine(get("item", "$.infoType.name"), _is("STRING")),
            _fine(get("item", "$.likelihood"), _is("STRING")),
            f"{offset('start')} IS NOT NULL",
            f"{offset('end')} IS NOT NULL",
        ]
    )
    name = f"coalesce({get('item', '$.infoType.name', 'string')}, '')"
    finding = struct(
        entity_type=bind(name, "info", canonical_entity("info")),
        start=offset("start"),
        end=offset("end"),
        score=likelihood_score(get("item", "$.likelihood", "string")),
    )
    items = get("res", "$.result.findings", "array<variant>")
    return bind(
        f"try_parse_json({json})",
        "res",
        f"""CASE WHEN res IS NULL THEN {_failed(note)}
            WHEN is_variant_null(res) THEN {_nothing()}
            WHEN NOT ({_fine('res', _OBJECT)} AND {_fine(get('res', '$.result'), _OBJECT)})
            THEN {_failed(note)}
            WHEN {_fine(get('res', '$.result.findings'), 'false')} THEN {_nothing()}
            WHEN {items} IS NOT NULL THEN {_checked(items, ok, finding, note)}
            ELSE {_failed(note)} END""",
    )


def ingest_analyzer_findings(
    df: DataFrame, json: str = "json", entities: Iterable[str] | None = None
) -> DataFrame:
    """Analyzer result JSON to findings."""
    return _ingest(df, F.expr(analyzer_findings(json)), entities, None)


def ingest_inspect_findings(
    df: DataFrame,
    json: str = "json",
    entities: Iterable[str] | None = None,
    threshold: float = 0.0,
) -> DataFrame:
    """Inspect result JSON to findings: names mapped, likelihood scored, low
    scores dropped.  The allowlist is applied to the mapped names, always."""
    return _ingest(df, F.expr(inspect_findings(json)), entities, threshold)


def _ingest(
    df: DataFrame,
    parsed: Column,
    entities: Iterable[str] | None,
    threshold: float | None,
) -> DataFrame:
    findings = allow_entities("_parsed.findings", entities)
    if threshold is not None:
        findings = filter_score(findings, threshold)
    return (
        df.withColumn("_parsed", parsed)
        .withColumns(
            {"findings": F.expr(findings), "detect_error": F.col("_parsed.error")}
        )
        .drop("_parsed")
    )


BatchDetector = Callable[[Sequence[str], str], Sequence[Sequence[Mapping]]]


def batch_findings(
    detector: BatchDetector, language: str
) -> Callable[[Sequence[str]], list[tuple[list[dict] | None, str | None]]]:
    """Texts to (findings, error) of each, by a user-supplied batch detector.

    The detector gets the non-blank texts.  If it raises, they are tried again one by
    one, so only the texts that really fail carry an error.
    """

    def one(found: Sequence[Mapping]) -> list[dict]:
        out = []
        for f in found:
            score = float(f.get("score", 0.0))
            if math.isnan(score):
                raise ValueError("score is not a number")
            start, end = int(f.get("start", 0)), int(f.get("end", 0))
            if not all(-(1 << 31) <= x < 1 << 31 for x in (start, end)):
                raise ValueError("offset out of range")
            entity = str(f.get("entity_type", ""))
            out.append({"entity_type": entity, "start": start, "end": end, "score": score})
        return out

    def attempt(texts: list[str]) -> list[tuple]:
        found = list(detector(texts, language))
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} results for {len(texts)} texts")
        return [(one(f), None) for f in found]

    def run(texts: Sequence[str]) -> list[tuple]:
        rows: list[tuple] = [([], None)] * len(texts)
        todo = [i for i, t in enumerate(texts) if t is not None and t.strip()]
        try:
            done = attempt([texts[i] for i in todo]) if todo else []
        except Exception:
            done = []
            for i in todo:
                try:
                    done += attempt([texts[i]])
                except Exception as e:
                    done.append((None, f"{type(e).__name__}: {e}"))
        for i, row in zip(todo, done, strict=True):
            rows[i] = row
        return rows

    return run


def detect_with(
    df: DataFrame,
    detector: BatchDetector,
    text: str = "text",
    language: str = "en",
    entities: Iterable[str] | None = None,
) -> DataFrame:
    """Findings from a user-supplied batch detector.

    ``detector(texts, language)`` gets the non-blank texts of one Arrow batch
    and returns, per text, mappings with ``entity_type``, ``start``, ``end`` and
    ``score``; see :func:`batch_findings` for errors.
    """
    find = batch_findings(detector, language)

    @F.pandas_udf(f"struct<findings:{FINDINGS},error:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(find(texts.tolist()), columns=["findings", "error"])

    return _ingest(df, run(F.col(text)), entities, None)


def detect(
    df: DataFrame,
    options: Options,
    text: str = "text",
    detector: BatchDetector | None = None,
) -> DataFrame:
    """Detector chosen by ``options.backend`` (or ``detector`` when given)."""
    if detector is not None:
        return detect_with(df, detector, text, options.language, options.entities)
    backend = check_backend(options)
    if backend == "regex":
        return detect_regex(df, text, options.entities)
    if backend == "dictionary":
        return detect_dictionary(df, options.terms, text, options.entities)
    if options.result_column not in df.columns:
        raise ValueError(
            f"backend {backend!r} reads results from column "
            f"{options.result_column!r}, which the table does not have"
        )
    if backend == "gcpdlp":
        return ingest_inspect_findings(
            df, options.result_column, options.entities, options.threshold
        )
    return ingest_analyzer_findings(df, options.result_column, options.entities)


def check_backend(options: Options) -> str:
    """Backend name with the empty name resolved; raises on bad settings."""
    backend = options.backend or "presidio"
    if backend not in ("presidio", "regex", "gcpdlp", "dictionary"):
        raise ValueError(
            f"unknown backend {backend!r} "
            "(want 'presidio', 'regex', 'gcpdlp' or 'dictionary')"
        )
    if backend == "gcpdlp" and not options.inspect_project.strip():
        raise ValueError("backend 'gcpdlp' needs inspect_project")
    if backend == "dictionary" and not options.terms:
        raise ValueError("backend 'dictionary' needs terms")
    return backend


def findings_long(df: DataFrame, *keys: str) -> DataFrame:
    """One row per finding, next to the key columns."""
    return inline_rows(df, keys, "findings")
