"""Dictionary findings: every occurrence of listed terms.

Arguments and results are SQL text; see ``exprs``.
"""

from __future__ import annotations

from collections.abc import Mapping

from veilmark.functions.exprs import FINDINGS, bind, empty, struct, text_literal
from veilmark.functions.fixed import DICTIONARY_SCORE


def _java_literal(term: str) -> str:
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def any_term(text: str, terms: Mapping[str, str]) -> str:
    """Whether any term occurs in ``text``."""
    pattern = "|".join(_java_literal(t) for t in terms if t)
    return f"rlike({text}, {text_literal(pattern)})" if pattern else "false"


def dictionary_findings(
    text: str, terms: Mapping[str, str], score: float = DICTIONARY_SCORE
) -> str:
    """Findings of all occurrences, overlapping ones too, sorted by start; ungated.

    Text is split at every position where some term starts (a zero-width
    look-ahead), so piece lengths give all starts in one pass; terms are then
    compared at those positions only.
    """
    terms = {t: e for t, e in terms.items() if t}
    if not terms:
        return empty(FINDINGS)
    starts_here = "(?=" + "|".join(_java_literal(t) for t in terms) + ")"
    longest = max(len(t) for t in terms)
    table = (
        "array("
        + ", ".join(
            struct(term=text_literal(t), entity_type=text_literal(e))
            for t, e in terms.items()
        )
        + ")"
    )
    starts = f"""aggregate(
        split({text}, {text_literal(starts_here)}, -1),
        {struct(pos="0", out=empty("array<int>"))},
        (acc, piece) -> {struct(
            pos="acc.pos + length(piece)", out="concat(acc.out, array(acc.pos))")},
        acc -> acc.out)"""
    finding = struct(
        entity_type="t.entity_type",
        start="at",
        end="at + length(t.term)",
        score=f"cast({score!r} as double)",
    )
    here = bind(
        f"substring({text}, at + 1, {longest})",
        "ahead",
        f"transform(filter({table}, t -> startswith(ahead, t.term)), t -> {finding})",
    )
    return f"flatten(transform({starts}, at -> {here}))"


def gated_dictionary(text: str, terms: Mapping[str, str]) -> str:
    return (
        f"CASE WHEN {any_term(text, terms)} THEN {dictionary_findings(text, terms)} "
        f"WHEN {text} IS NOT NULL THEN {empty(FINDINGS)} END"
    )
