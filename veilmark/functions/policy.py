"""Actions per finding as Catalyst expressions.

Arguments and results are SQL text; see ``exprs``.
"""

from __future__ import annotations

from veilmark.functions.exprs import MAPPINGS, bind, empty, is_blank, struct
from veilmark.functions.spans import select_spans
from veilmark.functions.tokens import labelled_token, normalize_entity

TOKENIZE, MASK, BLOCK, AUDIT = "tokenize", "mask", "block", "audit"
# from the mildest to the strictest
ACTIONS = (AUDIT, TOKENIZE, MASK, BLOCK)
ANY = "*"
AUDITED = "array<struct<entity_type:string,action:string,`start`:int,`end`:int>>"
ACTED = f"struct<text:string,mappings:{MAPPINGS},audit:{AUDITED},blocked:boolean>"


def left_alone(text: str) -> str:
    fields = struct(
        text=text, mappings=empty(MAPPINGS), audit=empty(AUDITED), blocked="false"
    )
    return f"cast({fields} as {ACTED})"


def act_on(text: str, findings: str, actions: str, default: str, salt: str) -> str:
    """``struct(text, mappings, audit, blocked)`` after each chosen finding's action.

    ``actions`` is a map from entity type to action, ``*`` for any other.  Overlaps are settled
    first, so an action never hides a finding from another one.  Tokenized spans become
    tokens, masked ones their label in angle brackets, audited ones stay; one blocked span
    blocks the text, which is null then, with no mappings.
    """
    value = f"substring({text}, s.`start` + 1, s.`end` - s.`start`)"
    action = (
        f"coalesce(try_element_at({actions}, s.entity_type), "
        f"try_element_at({actions}, '{ANY}'), '{default}')"
    )
    labelled = struct(
        start="s.`start`",
        end="s.`end`",
        value=value,
        found="s.entity_type",
        entity_type=normalize_entity("s.entity_type"),
        action=action,
    )
    token = f"if(w.action = '{TOKENIZE}', {labelled_token('w.entity_type', 'w.value', salt)}, null)"
    new = f"""CASE w.action WHEN '{TOKENIZE}' THEN w.token
              WHEN '{MASK}' THEN concat('<', w.entity_type, '>') ELSE w.value END"""
    fields = dict(
        start="w.`start`", end="w.`end`", value="w.value", found="w.found",
        entity_type="w.entity_type", action="w.action",
    )
    with_token = f"transform(transform(chosen, s -> {labelled}), w -> {struct(**fields, token=token)})"
    parts = f"transform({with_token}, w -> {struct(**fields, token='w.token', new=new)})"
    before = "coalesce(get(parts, i - 1).`end`, 0)"
    piece = f"concat(substring({text}, {before} + 1, p.`start` - {before}), p.new)"
    end = "coalesce(get(parts, size(parts) - 1).`end`, 0)"
    blocked = f"exists(parts, p -> p.action = '{BLOCK}')"
    mapping = struct(token="p.token", value="p.value", entity_type="p.entity_type")
    entry = struct(entity_type="p.found", action="p.action", start="p.`start`", end="p.`end`")
    spliced = (
        f"concat(array_join(transform(parts, (p, i) -> {piece}), ''), substring({text}, {end} + 1))"
    )
    fields = struct(
        text=f"if({blocked}, null, {spliced})",
        mappings=f"if({blocked}, {empty(MAPPINGS)}, "
        f"transform(filter(parts, p -> p.action = '{TOKENIZE}'), p -> {mapping}))",
        audit=f"transform(parts, p -> {entry})",
        blocked=blocked,
    )
    done = bind(parts, "parts", f"cast({fields} as {ACTED})")
    some = f"size(chosen) > 0 AND NOT {is_blank(text)}"
    chosen = bind(
        select_spans("found", f"length({text})"),
        "chosen",
        f"if({some}, {done}, {left_alone(text)})",
    )
    return bind(findings, "found", f"if(size(found) > 0, {chosen}, {left_alone(text)})")
