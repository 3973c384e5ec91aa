"""Tool calls and results in JSON bodies, with JSON held inside JSON strings.

Only the characters of a finding change.  A finding inside an inner document is put back
through the escapes of every string around it, so that all other bytes stay as they were
written, at each level.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import functions as F

from veilmark.functions.bodypatch import PATCHED, literals
from veilmark.functions.longtext import _BLANK, Span, choose, label, token

LEVELS = 8
_PIECE = re.compile(
    r"[^\\]+|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.", re.S
)
Edit = tuple[int, int, str]


def text_of(raw: str) -> str:
    """The text of a string literal."""
    return json.loads(raw, strict=False) if "\\" in raw else raw[1:-1]


def unescaped(raw: str) -> tuple[str, Sequence[int]]:
    """The text of a string literal, and where each of its characters begins in it; one
    entry more is the literal's closing quote."""
    if "\\" not in raw:
        return raw[1:-1], range(1, len(raw))
    places: list[int] = []
    for piece in _PIECE.finditer(raw, 1, len(raw) - 1):
        start, stop = piece.span()
        if raw[start] == "\\":
            places.append(start)
        else:
            places.extend(range(start, stop))
    places.append(len(raw) - 1)
    return text_of(raw), places


def escaped(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)[1:-1]


def document(text: str):
    """The object or array a text is, or None."""
    if text.lstrip()[:1] not in ("{", "["):
        return None
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, (dict, list)) else None


def places_of(root) -> list[tuple]:
    """Paths below which all strings belong to a tool call or its result."""
    if isinstance(root, list):
        return [(k, *path) for k, item in enumerate(root) if isinstance(item, dict) for path in places_of(item)]
    found: list[tuple] = []
    if root.get("method") == "tools/call":
        found.append(("params", "arguments"))
    result = root.get("result")
    if isinstance(result, dict):
        found.append(("result", "structuredContent"))
        content = result.get("content")
        for k, part in enumerate(content if isinstance(content, list) else ()):
            if isinstance(part, dict):
                found += [("result", "content", k, "text"), ("result", "content", k, "resource", "text")]
    messages = root.get("messages")
    for k, message in enumerate(messages if isinstance(messages, list) else ()):
        if not isinstance(message, dict):
            continue
        calls = message.get("tool_calls")
        for j, call in enumerate(calls if isinstance(calls, list) else ()):
            found.append(("messages", k, "tool_calls", j, "function", "arguments"))
        if message.get("role") == "tool":
            found.append(("messages", k, "content"))
    return found


def edits_of(
    text: str, root, match: Callable[[str], list[Span]], salt: str, mappings: list, below: list[tuple], level: int = 1
) -> list[Edit]:
    """Edits of a JSON text, by position: its findings below the given paths."""
    edits: list[Edit] = []
    sizes = {len(p) for p in below}
    wanted = set(below)
    for path, (start, stop) in literals(text).items():
        if not any(path[:n] in wanted for n in sizes if n <= len(path)):
            continue
        raw = text[start:stop]
        value = text_of(raw)
        inner = document(value) if level < LEVELS else None
        if inner is not None:
            found = edits_of(value, inner, match, salt, mappings, [()], level + 1)
        else:
            found = []
            if not _BLANK.fullmatch(value):
                for a, b, _, entity in choose(match(value), len(value)):
                    new = token(entity, value[a:b], salt)
                    mappings.append({"token": new, "value": value[a:b], "entity_type": label(entity)})
                    found.append((a, b, new))
        if found:
            _, places = unescaped(raw)
            edits += [(start + places[a], start + places[b], escaped(new)) for a, b, new in found]
    return edits


def patched(body: str, match: Callable[[str], list[Span]], salt: str) -> tuple[str, list]:
    """(body, mappings); a body that holds no tool call keeps its bytes."""
    root = document(body)
    below = [] if root is None else places_of(root)
    if not below:
        return body, []
    mappings: list[dict] = []
    out, at = [], 0
    for start, stop, new in sorted(edits_of(body, root, match, salt, mappings, below)):
        out += (body[at:start], new)
        at = stop
    return "".join(out) + body[at:], mappings


def patch_tools_udf(match: Callable[[str], list[Span]], salt: str):
    """Body -> struct(body, mappings, error); null in, null out."""

    @F.pandas_udf(PATCHED)
    def run(bodies: pd.Series) -> pd.DataFrame:
        rows = []
        for body in bodies:
            try:
                rows.append((None, None, None) if body is None else (*patched(body, match, salt), None))
            except Exception as e:
                rows.append((None, [], f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["body", "mappings", "error"])

    return run
