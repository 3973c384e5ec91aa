"""Span expressions: validity, overlap choice, replacing spans by tokens.

Arguments and results are SQL text; see ``exprs``.
"""

from __future__ import annotations

from collections.abc import Iterable

from veilmark.functions.exprs import (
    FINDINGS,
    MAPPINGS,
    REDACTED,
    bind,
    empty,
    is_blank,
    struct,
    text_literal,
)
from veilmark.functions.tokens import labelled_token, normalize_entity


def validate_spans(findings: str, length: str) -> str:
    """Keep findings with 0 <= start < end <= length."""
    return (
        f"filter({findings}, f -> f.`start` >= 0 AND f.`start` < f.`end` "
        f"AND f.`end` <= {length})"
    )


def select_spans(findings: str, length: str) -> str:
    """Greedy choice of disjoint spans, ordered by start.

    Candidates are taken by earliest start, then longest, then highest score,
    then input order; one that overlaps a span already taken is dropped.
    """
    rank = struct(
        start="f.`start`",
        neg_end="-f.`end`",
        neg_score="-f.score",
        ord="i",
        entity_type="f.entity_type",
    )
    ranked = f"array_sort(transform({validate_spans(findings, length)}, (f, i) -> {rank}))"
    span = struct(
        entity_type="c.entity_type",
        start="c.`start`",
        end="-c.neg_end",
        score="-c.neg_score",
    )
    taken = struct(last="-c.neg_end", kept=f"concat(acc.kept, array({span}))")
    return f"""aggregate(
        {ranked},
        {struct(last="0", kept=empty(FINDINGS))},
        (acc, c) -> if(c.`start` >= acc.last, {taken}, acc),
        acc -> acc.kept)"""


def unchanged(text: str) -> str:
    return f"cast({struct(text=text, mappings=empty(MAPPINGS))} as {REDACTED})"


def splice_tokens(text: str, spans: str, salt: str) -> str:
    """Replace disjoint, ordered ``spans`` of ``text`` by tokens.

    Gives ``struct(text, mappings)`` with one mapping per span.
    """
    value = f"substring({text}, s.`start` + 1, s.`end` - s.`start`)"
    labelled = struct(
        start="s.`start`",
        end="s.`end`",
        value=value,
        entity_type=normalize_entity("s.entity_type"),
    )
    with_token = struct(
        start="w.`start`",
        end="w.`end`",
        value="w.value",
        entity_type="w.entity_type",
        token=labelled_token("w.entity_type", "w.value", salt),
    )
    parts = f"transform(transform({spans}, s -> {labelled}), w -> {with_token})"

    before = "coalesce(get(parts, i - 1).`end`, 0)"
    piece = (
        f"concat(substring({text}, {before} + 1, p.`start` - {before}), p.token)"
    )
    end = "coalesce(get(parts, size(parts) - 1).`end`, 0)"
    joined = struct(
        text=f"concat(array_join(transform(parts, (p, i) -> {piece}), ''), "
        f"substring({text}, {end} + 1))",
        mappings="transform(parts, p -> "
        + struct(token="p.token", value="p.value", entity_type="p.entity_type")
        + ")",
    )
    return bind(parts, "parts", f"cast({joined} as {REDACTED})")


def redact_text(text: str, findings: str, salt: str) -> str:
    """Findings to ``struct(text, mappings)``; blank text is left alone."""
    chosen = bind(
        select_spans("found", f"length({text})"),
        "chosen",
        f"if(size(chosen) > 0 AND NOT {is_blank(text)}, "
        f"{splice_tokens(text, 'chosen', salt)}, {unchanged(text)})",
    )
    return bind(
        findings, "found", f"if(size(found) > 0, {chosen}, {unchanged(text)})"
    )


def allow_entities(findings: str, entities: Iterable[str] | None) -> str:
    """Keep listed entity types; none or empty keeps all."""
    allowed = sorted(set(entities or ()))
    if not allowed:
        return findings
    names = ", ".join(text_literal(e) for e in allowed)
    return f"filter({findings}, f -> f.entity_type IN ({names}))"


def filter_score(findings: str, threshold: float) -> str:
    """Drop findings below ``threshold``; a score equal to it stays."""
    return f"filter({findings}, f -> f.score >= cast({threshold!r} as double))"
