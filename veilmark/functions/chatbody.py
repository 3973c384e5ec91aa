"""Chat bodies as VARIANT expressions: where the text fields are.

Arguments and results are SQL text; see ``exprs``.
"""

from __future__ import annotations

from veilmark.functions.exprs import bind, empty, struct

# The top-level fields that carry text, in walk order.
TOP_FIELDS = ("system", "prompt", "input")

FIELD = "struct<path:string,pos:int,part_pos:int,text:string>"
FIELDS = f"array<{FIELD}>"


def get(variant: str, path: str, type: str = "variant") -> str:
    return f"try_variant_get({variant}, '{path}', '{type}')"


def parse_body(body: str) -> str:
    """The body as VARIANT, or null unless it is exactly one JSON value.

    The parser stops at the end of the first value, so trailing text would go
    unseen.  The body is therefore parsed as the first of two array items, the
    second being the body's own digest, which no trailing text can forge.
    """
    pair = f"try_parse_json(concat('[', {body}, ',\"', md5({body}), '\"]'))"
    return bind(
        pair,
        "pair",
        f"CASE WHEN {get('pair', '$[1]', 'string')} = md5({body}) "
        f"AND {get('pair', '$[2]')} IS NULL THEN {get('pair', '$[0]')} END",
    )


def _text_of(variant: str) -> str:
    """String content of a variant; null for any other type."""
    return bind(
        variant,
        "v",
        f"CASE WHEN schema_of_variant(v) = 'STRING' THEN {get('v', '$', 'string')} END",
    )


def _field(path: str, pos: str, part: str, text: str) -> str:
    fields = struct(path=f"'{path}'", pos=pos, part_pos=part, text=text)
    return f"cast({fields} as {FIELD})"


def _content_fields(content: str, path: str, pos: str) -> str:
    """Text fields of one content value: a string, or an array of parts."""
    none = "cast(null as int)"
    of_parts = (
        "transform(parts, (part, j) -> "
        + _field(path, pos, "j", _text_of(get("part", "$.text")))
        + ")"
    )
    whole = f"array({_field(path, pos, none, _text_of('content'))})"
    read = bind(
        get("content", "$", "array<variant>"),
        "parts",
        f"filter(if(parts IS NOT NULL, {of_parts}, {whole}), fld -> fld.text IS NOT NULL)",
    )
    return bind(content, "content", f"if(content IS NULL, {empty(FIELDS)}, {read})")


def body_fields(parsed: str) -> str:
    """All text fields of a parsed body, in walk order."""
    top = [
        _content_fields(get(parsed, f"$.{name}"), name, "cast(null as int)")
        for name in TOP_FIELDS
    ]
    messages = (
        f"coalesce({get(parsed, '$.messages', 'array<variant>')}, "
        f"{empty('array<variant>')})"
    )
    of_message = _content_fields(get("msg", "$.content"), "messages", "n")
    return (
        f"concat({', '.join(top)}, "
        f"flatten(transform({messages}, (msg, n) -> {of_message})))"
    )


def parsed_fields(body: str) -> str:
    """Text fields of a body; null when :func:`parse_body` refuses it."""
    return bind(
        parse_body(body), "root", f"CASE WHEN root IS NOT NULL THEN {body_fields('root')} END"
    )
