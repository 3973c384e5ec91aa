"""Provider vocabulary: entity names, likelihood scores, lenient integers.

Arguments and results are SQL text; see ``exprs``.
"""

from __future__ import annotations

from veilmark.functions.fixed import (
    INSPECT_INFO_TYPES,
    LIKELIHOOD_SCORES,
    UNKNOWN_LIKELIHOOD_SCORE,
)


def canonical_entity(info_type: str) -> str:
    """Entity name for an inspect info type; unknown names pass through."""
    cases = " ".join(
        f"WHEN '{info}' THEN '{entity}'" for entity, info in INSPECT_INFO_TYPES.items()
    )
    return f"CASE {info_type} {cases} ELSE {info_type} END"


def likelihood_score(likelihood: str) -> str:
    """Score of a likelihood name; 0.5 for any other name."""
    cases = " ".join(
        f"WHEN '{name}' THEN {score}D" for name, score in LIKELIHOOD_SCORES.items()
    )
    return f"CASE {likelihood} {cases} ELSE {UNKNOWN_LIKELIHOOD_SCORE}D END"


def flexible_int(text: str) -> str:
    """Integer given as number or quoted string; absent, null or empty is 0.

    Null result for a non-null, non-empty input means it is not an integer.
    """
    return (
        f"CASE WHEN coalesce({text}, '') = '' THEN 0 "
        f"WHEN rlike({text}, '^[+-]?[0-9]+$') THEN try_cast({text} as int) END"
    )
