"""The six built-in rules as Catalyst expressions.

Patterns are written in RE2 spelling.  Java differs in three ways that matter
here: ``\\b`` is Unicode-aware, ``\\s`` includes the vertical tab, and matching
backtracks.  ``java_pattern`` spells the same language for Java and adds a
first-character look-ahead, so a position that cannot start a match costs one
character test.  The local part of an address is only tried from the start of a
run of address characters (or where the previous match ended), which keeps a
long unbroken run linear instead of quadratic.
"""

from __future__ import annotations

from collections.abc import Iterable

from veilmark.functions.exprs import FINDINGS, bind, empty, struct, text_literal
from veilmark.functions.fixed import RULE_PATTERNS, RULE_SCORE

_WORD = "[0-9A-Za-z_]"
_ASCII_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_RE2_SPACE = r"\t\n\f\r "
_LOCAL = r"a-zA-Z0-9._%+\-"

# Characters that can start a match of each rule.
_FIRST = {
    "US_SSN": "[0-9]",
    "CREDIT_CARD": "[0-9]",
    "PHONE_NUMBER": "[0-9+(]",
    "IP_ADDRESS": "[0-9]",
    "URL": "h",
}

# Text without this cannot match the rule.
_NEEDS = {"EMAIL_ADDRESS": "@", "URL": "://"}

# Text in which this does not match after a digit cannot match the rule.
_DIGIT_HINTS = {
    "US_SSN": r"[0-9]{2}-[0-9]{2}-",
    "CREDIT_CARD": r"[0-9]{3}[ \-]?[0-9]{4}",
    "PHONE_NUMBER": r"[0-9]{2}\)?[ .\-][0-9]{3}[ .\-]",
    "IP_ADDRESS": r"[0-9]{0,2}\.[0-9]{1,3}\.[0-9]",
}


def rule_names(entities: Iterable[str] | None = None) -> list[str]:
    """Rules kept by an allowlist; none or empty keeps all."""
    allowed = set(entities or ())
    return [r for r in RULE_PATTERNS if not allowed or r in allowed]


def java_pattern(rule: str) -> str:
    pattern = RULE_PATTERNS[rule]
    if rule == "EMAIL_ADDRESS":
        local, domain = pattern.split("@")
        return rf"(?:\G|(?<![{_LOCAL}])){local}+@{domain}"
    pattern = pattern.replace(r"[^\s]", f"[^{_RE2_SPACE}]")
    pattern = pattern.replace(r"\b", _ASCII_BOUNDARY)
    return f"(?={_FIRST[rule]}){pattern}"


def gate(text: str, rules: Iterable[str]) -> str:
    """Necessary condition for any of ``rules`` to match, in one cheap pass.

    Two byte searches and at most one digit-anchored regex; most text fails all
    of them and never reaches the rules.
    """
    rules = list(rules)
    tests = [f"contains({text}, '{_NEEDS[r]}')" for r in rules if r in _NEEDS]
    hints = [_DIGIT_HINTS[r] for r in rules if r in _DIGIT_HINTS]
    if hints:
        pattern = "[0-9](?:" + "|".join(hints) + ")"
        tests.append(f"rlike({text}, {text_literal(pattern)})")
    return "(" + " OR ".join(tests or ["false"]) + ")"


_SPANS = "array<struct<`start`:int,ord:int,`end`:int>>"


def _rule_spans(text: str, rule: str, order: int) -> str:
    """Spans of one rule as (start, ord, end) structs.

    Matches and the gaps between them alternate, so each start is the length of
    all gaps up to and including its own plus all earlier matches.  ``length``
    counts code points, which is what spans are measured in.
    """
    pattern = text_literal(java_pattern(rule))
    sizes = (
        f"zip_with(split({text}, {pattern}, -1), hits, "
        "(g, h) -> named_struct('gap', length(g), 'len', length(h)))"
    )
    span = struct(start="acc.pos + x.gap", ord=str(order), end="acc.pos + x.gap + x.len")
    # the last gap has no match after it
    located = f"""aggregate(
        slice({sizes}, 1, size(hits)),
        {struct(pos="0", out=empty(_SPANS))},
        (acc, x) -> {struct(
            pos="acc.pos + x.gap + x.len", out=f"concat(acc.out, array({span}))")},
        acc -> acc.out)"""
    spans = bind(
        f"regexp_extract_all({text}, {pattern}, 0)",
        "hits",
        f"if(size(hits) > 0, {located}, {empty(_SPANS)})",
    )
    if rule in _NEEDS:
        return f"if(contains({text}, '{_NEEDS[rule]}'), {spans}, {empty(_SPANS)})"
    return spans


def rule_findings(text: str, rules: Iterable[str]) -> str:
    """Findings of ``rules`` in ``text``, sorted by start; ungated.

    Equal starts keep rule order.
    """
    rules = list(rules)
    if not rules:
        return empty(FINDINGS)
    names = "array(" + ", ".join(f"'{r}'" for r in rules) + ")"
    spans = ", ".join(_rule_spans(text, r, i) for i, r in enumerate(rules))
    finding = struct(
        entity_type=f"get({names}, sp.ord)",
        start="sp.`start`",
        end="sp.`end`",
        score=f"cast({RULE_SCORE} as double)",
    )
    return f"transform(array_sort(concat({spans})), sp -> {finding})"


def gated_findings(text: str, entities: Iterable[str] | None = None) -> str:
    """:func:`rule_findings` of the allowed rules behind :func:`gate`."""
    rules = rule_names(entities)
    return (
        f"CASE WHEN {gate(text, rules)} THEN {rule_findings(text, rules)} "
        f"WHEN {text} IS NOT NULL THEN {empty(FINDINGS)} END"
    )
