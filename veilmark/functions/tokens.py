"""Token expressions: build tokens, recognise them, put values back.

Arguments and results are SQL text; see ``exprs``.
"""

from __future__ import annotations

import string

from veilmark.functions.exprs import bind, empty, text_literal
from veilmark.functions.fixed import (
    FALLBACK_ENTITY,
    TOKEN_ID_LENGTH,
    TOKEN_LABEL_LENGTH,
    TOKEN_MARKER,
    TOKEN_PATTERN,
    TOKEN_SUFFIX,
)

# Letters whose simple upper case lies in the token alphabet: a-z, dotless i, long s.
LOWER = string.ascii_lowercase + "ıſ"
UPPER = string.ascii_uppercase + "IS"


def normalize_entity(entity: str) -> str:
    """Token label for an entity type: upper case, other characters to ``_``.

    ``translate`` is used instead of ``upper`` because full upper-casing turns
    some letters into two (sharp s), which would change the label.  Longer labels
    are cut to what a token of the greatest length can hold.
    """
    upper = f"translate(coalesce({entity}, ''), '{LOWER}', '{UPPER}')"
    label = f"regexp_replace({upper}, '[^A-Z0-9_]+', '_')"
    label = f"regexp_replace({label}, '^_+|_+$', '')"
    cut = f"substring(lbl, 1, {TOKEN_LABEL_LENGTH})"
    return bind(label, "lbl", f"if(lbl = '', '{FALLBACK_ENTITY}', {cut})")


class SaltColumn(str):
    """A salt that differs by row: the SQL text of its column."""


def token_id(value: str, salt: str) -> str:
    """First 16 hex digits of sha256(salt NUL value); ``salt`` is plain text, or a column."""
    prefix = text_literal(salt + "\x00")
    if isinstance(salt, SaltColumn):
        prefix = f"concat({salt}, cast(X'00' as string))"
    return f"substring(sha2(concat({prefix}, {value}), 256), 1, {TOKEN_ID_LENGTH})"


def labelled_token(label: str, value: str, salt: str) -> str:
    """Token for a label that is already normalized."""
    return (
        f"concat('{TOKEN_MARKER}', {label}, '_', {token_id(value, salt)}, "
        f"'{TOKEN_SUFFIX}')"
    )


def make_token(entity: str, value: str, salt: str) -> str:
    """Deterministic token for (entity, value, salt)."""
    return labelled_token(normalize_entity(entity), value, salt)


def has_marker(text: str) -> str:
    """Cheap necessary condition for holding a token (byte search, no regex)."""
    return f"contains({text}, '{TOKEN_MARKER}')"


def find_tokens(text: str) -> str:
    """All complete tokens in order of appearance."""
    return (
        f"CASE WHEN {has_marker(text)} "
        f"THEN regexp_extract_all({text}, {text_literal(TOKEN_PATTERN)}, 0) "
        f"WHEN {text} IS NOT NULL THEN {empty('array<string>')} END"
    )


def splice_values(text: str, values: str) -> str:
    """Put ``values`` in the place of the tokens of ``text``, in order.

    Unless there is exactly one value for each token, the text stays as it is.
    """
    gaps = f"split({text}, {text_literal(TOKEN_PATTERN)}, -1)"
    spliced = (
        f"array_join(zip_with(gaps, {values}, "
        "(gap, val) -> concat(gap, coalesce(val, ''))), '')"
    )
    return bind(gaps, "gaps", f"if(size(gaps) = size({values}) + 1, {spliced}, {text})")
