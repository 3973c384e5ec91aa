"""Arrow path for texts that are too long or too dense for array expressions.

Expressions index text by code point from its start, so many spans in one very
long text cost (spans x length).  Such rows, and only such rows, go through
these helpers, which are linear.  Both paths give the same result; the tests
compare them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import functions as F

from veilmark.functions.exprs import FINDINGS, REDACTED
from veilmark.functions.fixed import (
    FALLBACK_ENTITY,
    RULE_PATTERNS,
    RULE_SCORE,
    TOKEN_ID_LENGTH,
    TOKEN_LABEL_LENGTH,
    TOKEN_MARKER,
    TOKEN_SUFFIX,
    WHITE_SPACE,
)
from veilmark.functions.tokens import LOWER, UPPER
from veilmark.functions.windows import bitmap_bits, bitmap_of, candidates

# Rows above either bound take the Arrow path.
LONG_TEXT_BYTES = 64 * 1024
# Finding spans alone grows an array per match, so it changes over earlier.
DETECT_BYTES = 16 * 1024
DENSE_WORK = 1 << 24  # findings x bytes

# A regex tries its alternatives one after the other; longer term lists than
# this are found by the hashes of their windows.
REGEX_TERMS = 200

Span = tuple[int, int, float, str]  # start, end, score, entity type

_BLANK = re.compile(f"[{WHITE_SPACE}]*")
_ASCII_UPPER = str.maketrans(LOWER, UPPER)


def _address_spans(text: str):
    local, domain = RULE_PATTERNS["EMAIL_ADDRESS"].split("@")
    at_run_start = re.compile(rf"(?<!{local[:-1]}){local}+@{domain}")
    right_here = re.compile(rf"{local}+@{domain}")
    pos = 0
    while True:
        # a match may follow the previous one inside the same run
        m = (pos and right_here.match(text, pos)) or at_run_start.search(text, pos)
        if not m:
            return
        yield m.span()
        pos = m.end()


def rule_matcher(rules: Iterable[str]) -> Callable[[str], list[Span]]:
    """Text -> spans of the named rules, in rule order."""
    plain = {
        rule: re.compile(
            RULE_PATTERNS[rule].replace(r"[^\s]", r"[^\t\n\f\r ]"), re.ASCII
        )
        for rule in rules
    }

    def match(text: str) -> list[Span]:
        spans: list[Span] = []
        for rule, pattern in plain.items():
            if rule == "EMAIL_ADDRESS":
                found = _address_spans(text) if "@" in text else ()
            else:
                found = (m.span() for m in pattern.finditer(text))
            spans.extend((a, b, RULE_SCORE, rule) for a, b in found)
        spans.sort(key=lambda s: s[0])
        return spans

    return match


def term_matcher(terms: Mapping[str, str], score: float) -> Callable[[str], list[Span]]:
    """Text -> every occurrence, overlapping ones too, of every term."""
    terms = {t: e for t, e in terms.items() if t}

    def one_by_one(text: str) -> list[Span]:
        spans: list[Span] = []
        for term, entity in terms.items():
            at = text.find(term)
            while at >= 0:
                spans.append((at, at + len(term), score, entity))
                at = text.find(term, at + 1)
        return spans

    if len(terms) <= REGEX_TERMS:
        return one_by_one

    sizes, bits = sorted({len(t) for t in terms}), bitmap_bits(len(terms))
    bitmap = bitmap_of(terms, bits)

    def by_windows(text: str) -> list[Span]:
        return [
            (at, at + len(term), score, terms[term])
            for at, term in candidates(text, bitmap, sizes, bits)
            if term in terms
        ]

    return by_windows


def find_matched_udf(match: Callable[[str], list[Span]]):
    """Findings of a string matcher, sorted by start; null in, null out."""

    @F.pandas_udf(FINDINGS)
    def run(texts: pd.Series) -> pd.Series:
        def found(text):
            if text is None:
                return None
            return [
                {"entity_type": e, "start": a, "end": b, "score": s}
                for a, b, s, e in sorted(match(text), key=lambda x: x[:2])
            ]

        return pd.Series([found(t) for t in texts], dtype=object)

    return run


def choose(spans: Iterable[Span], length: int) -> list[Span]:
    valid = [
        s for s in spans if None not in s[:2] and 0 <= s[0] < s[1] <= length
    ]
    # a null score is the lowest
    valid.sort(key=lambda s: (s[0], -s[1], s[2] is None, -(s[2] or 0.0)))
    kept: list[Span] = []
    for s in valid:
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept


def label(entity: str) -> str:
    text = re.sub("[^A-Z0-9_]+", "_", (entity or "").translate(_ASCII_UPPER))
    return text.strip("_")[:TOKEN_LABEL_LENGTH] or FALLBACK_ENTITY


def token(entity: str, value: str, salt: str) -> str:
    digest = hashlib.sha256(f"{salt}\x00{value}".encode()).hexdigest()
    return f"{TOKEN_MARKER}{label(entity)}_{digest[:TOKEN_ID_LENGTH]}{TOKEN_SUFFIX}"


def redact_string(text: str, spans: Iterable[Span], salt: str) -> tuple[str, list[dict]]:
    if _BLANK.fullmatch(text):
        return text, []
    pieces, mappings, last = [], [], 0
    for start, end, _, entity in choose(spans, len(text)):
        value = text[start:end]
        tok = token(entity, value, salt)
        pieces += (text[last:start], tok)
        mappings.append({"token": tok, "value": value, "entity_type": label(entity)})
        last = end
    pieces.append(text[last:])
    return "".join(pieces), mappings


def redact_matched_udf(match: Callable[[str], list[Span]], salt: str):
    """Detect and redact; null in, null out."""

    @F.pandas_udf(REDACTED)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [
            (None, None) if t is None else redact_string(t, match(t), salt)
            for t in texts
        ]
        return pd.DataFrame(rows, columns=["text", "mappings"])

    return run


def _given(number):
    """Arrow batches turn columns with nulls into floats, and nulls into NaN."""
    if number is None or number != number:
        return None
    return int(number) if number == int(number) else number


def _found(findings) -> list[Span]:
    return [
        (_given(f["start"]), _given(f["end"]), _given(f["score"]), f["entity_type"])
        for f in findings
    ]


def redact_found_udf():
    """Redact given findings with a row's salt; null in, null out."""

    @F.pandas_udf(REDACTED)
    def run(texts: pd.Series, findings: pd.Series, salts: pd.Series) -> pd.DataFrame:
        rows = [
            (None, None) if t is None else redact_string(t, _found(fs), salt)
            for t, fs, salt in zip(texts, findings, salts)
        ]
        return pd.DataFrame(rows, columns=["text", "mappings"])

    return run
