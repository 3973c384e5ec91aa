"""Arrow helpers that write text back into JSON bodies.

Spark cannot set a value inside a VARIANT, so this step, and only this step, is
Python, and only for bodies that change or that the expressions cannot parse
(repeated keys, which a JSON object resolves to the last one).  A changed body keeps
every byte outside the changed string literals.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from veilmark.functions.chatbody import FIELDS, TOP_FIELDS
from veilmark.functions.exprs import MAPPINGS
from veilmark.functions.longtext import Span, redact_string
from veilmark.functions.windows import text_runs

PATCHED = f"struct<body:string,mappings:{MAPPINGS},error:string>"

_MAPPING_ARROW = pa.struct([(name, pa.string()) for name in ("token", "value", "entity_type")])
_PATCHED_ARROW = pa.struct([("body", pa.string()), ("mappings", pa.list_(_MAPPING_ARROW)), ("error", pa.string())])
DETECT_RUN_BYTES = 1 << 20

Place = tuple[str, "int | None", "int | None"]  # path, pos, part_pos

_ITEM = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\],:]|[^\s"{}\[\],:]+', re.S)


def _reject(name: str):
    raise ValueError(f"not JSON: {name}")


def _finite(literal: str) -> float:
    number = float(literal)
    if number in (float("inf"), float("-inf")):
        raise ValueError(f"number out of range: {literal}")
    return number


def load(body: str) -> dict | None:
    """The body's object, or None when it is not one.

    Numbers beyond a double and nesting deeper than the reader's stack (about 1,000
    levels) count as not JSON, and the body is left as it is.
    """
    try:
        root = json.loads(body, parse_constant=_reject, parse_float=_finite)
    except (ValueError, RecursionError):
        return None
    return root if isinstance(root, dict) else None


def clean(text: str) -> str:
    """Halves of surrogate pairs, which JSON escapes can write, become U+FFFD."""
    if text.isascii():
        return text
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def slots(root: dict) -> Iterator[tuple[Place, str]]:
    """Place and text of every text field, in walk order."""

    def content(value, path: str, pos: int | None):
        if isinstance(value, str):
            yield (path, pos, None), clean(value)
        elif isinstance(value, list):
            for i, part in enumerate(value):
                if isinstance(part, dict) and isinstance(part.get("text"), str):
                    yield (path, pos, i), clean(part["text"])

    for name in TOP_FIELDS:
        yield from content(root.get(name), name, None)
    messages = root.get("messages")
    for i, message in enumerate(messages if isinstance(messages, list) else ()):
        if isinstance(message, dict):
            yield from content(message.get("content"), "messages", i)


def literals(body: str) -> dict[tuple, tuple[int, int]]:
    """Where each string value's literal lies in a valid body, by its path of keys and
    indices.  Of repeated keys the last one counts, with all below it."""
    found: dict[tuple, tuple[int, int]] = {}
    path: list = []
    expects_key = []  # per open container: None in an array, else whether a key is next
    seen: list[set] = []
    for match in _ITEM.finditer(body):
        item = match[0]
        if item in "{[":
            expects_key.append(True if item == "{" else None)
            path.append(None if item == "{" else 0)
            seen.append(set())
        elif item in "}]":
            expects_key.pop()
            path.pop()
            seen.pop()
        elif item == ",":
            if expects_key[-1] is None:
                path[-1] += 1
            else:
                expects_key[-1] = True
        elif item == ":":
            expects_key[-1] = False
        elif item[0] == '"':
            if expects_key[-1]:
                path[-1] = json.loads(item)
                if path[-1] in seen[-1]:
                    size, prefix = len(path), tuple(path)
                    for old in [p for p in found if p[:size] == prefix]:
                        del found[old]
                seen[-1].add(path[-1])
            else:
                found[tuple(path)] = match.span()
    return found


def rewrite(body: str, texts: Sequence[tuple[Place, str]]) -> str:
    """The body with new texts at their places, all else byte for byte."""
    spans = literals(body)
    edits = []
    for (path, pos, part), text in texts:
        way: tuple = (path,) if pos is None else (path, pos, "content")
        if part is not None:
            way += (part, "text")
        edits.append((spans[way], text))
    out, at = [], 0
    for (start, stop), text in sorted(edits):
        out += (body[at:start], json.dumps(text, ensure_ascii=False))
        at = stop
    return "".join(out) + body[at:]


def fields_udf():
    """Body -> its text fields, for bodies the VARIANT parser refuses."""

    @F.pandas_udf(FIELDS)
    def run(bodies: pd.Series) -> pd.Series:
        def fields(body):
            root = None if body is None else load(body)
            return [
                {"path": path, "pos": pos, "part_pos": part, "text": text}
                for (path, pos, part), text in slots(root or {})
            ]

        return bodies.map(fields, na_action=None)

    return run


def _redacted(body: str, root: dict, spans: Callable[[str], list[Span]], salt: str):
    """(body, mappings) with the spans of every field redacted."""
    mappings: list[dict] = []
    changed = []
    for place, text in slots(root):
        new, more = redact_string(text, spans(text), salt)
        if more:
            changed.append((place, new))
            mappings += more
    return (rewrite(body, changed) if changed else body), mappings


def patch_udf(match: Callable[[str], list[Span]], salt: str):
    """(body, old texts, new texts) -> struct(body, mappings, error).

    With texts: write the new ones into the fields, whose old ones must agree.
    Without, or if they do not agree: detect and redact right here, and return
    the mappings too.  A body that is not a JSON object comes back unchanged.  A row
    that cannot be worked on carries an error and ends nothing else.
    """

    def patched(body: str, old, new) -> tuple[str, list[dict] | None, None]:
        root = load(body)
        if root is None:
            return body, [], None
        found = list(slots(root))
        if old is not None and [text for _, text in found] == list(old):
            pairs = [
                (place, text)
                for (place, before), text in zip(found, new, strict=True)
                if text != before
            ]
            return rewrite(body, pairs), None, None
        return *_redacted(body, root, match, salt), None

    @F.pandas_udf(PATCHED)
    def run(bodies: pd.Series, old: pd.Series, new: pd.Series) -> pd.DataFrame:
        rows = []
        for b, o, n in zip(bodies, old, new):
            try:
                rows.append((None, None, None) if b is None else patched(b, o, n))
            except Exception as e:
                rows.append((None, [], f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["body", "mappings", "error"])

    return run


def detect_udf(find: Callable[[list[str]], list[tuple]], salt: str):
    """Body -> struct(body, mappings, error) by a batch detector.

    The fields of neighbouring bodies of one Arrow batch, about a megabyte together, go to
    ``find`` at once, which gives (spans, error) for each text; a failing text fails its
    whole body.  Nothing leaves the row, so ids of bodies play no part.
    """

    def worked(bodies: list[str | None]) -> list[dict]:
        roots = [None if b is None else load(b) for b in bodies]
        fields = [list(slots(r or {})) for r in roots]
        found = iter(find([text for row in fields for _, text in row]))
        rows = []
        for body, row in zip(bodies, fields):
            answers = [next(found) for _ in row]
            try:
                failed = [error for _, error in answers if error]
                if failed:
                    raise ValueError(failed[0])
                changed, mappings = [], []
                for (place, text), (spans, _) in zip(row, answers, strict=True):
                    new, more = redact_string(text, spans, salt)
                    if more:
                        changed.append((place, new))
                        mappings += more
                done = (rewrite(body, changed) if changed else body, mappings, None)
            except Exception as e:
                done = (None, [], str(e) or type(e).__name__)
            rows.append(dict(zip(("body", "mappings", "error"), done)))
        return rows

    @F.arrow_udf(PATCHED)
    def run(bodies: pa.Array) -> pa.Array:
        # only a few bodies at a time are Python's objects, and their parsed trees with them
        sizes = pc.binary_length(bodies).fill_null(0).to_numpy(zero_copy_only=False)
        parts = [
            pa.array(worked(bodies.slice(start, stop - start).to_pylist()), _PATCHED_ARROW)
            for start, stop in text_runs(sizes, DETECT_RUN_BYTES)
        ]
        return pa.concat_arrays(parts) if parts else pa.array([], _PATCHED_ARROW)

    return run


def rebuild_udf():
    """(body, new fields) -> body with the fields written at their places."""

    @F.pandas_udf("string")
    def run(bodies: pd.Series, fields: pd.Series) -> pd.Series:
        def rebuilt(body, new):
            root = None if body is None or new is None else load(body)
            if root is None:
                return body
            texts = {(f["path"], f["pos"], f["part_pos"]): f["text"] for f in new}
            changed = [
                (place, texts[place])
                for place, text in slots(root)
                if texts.get(place) is not None and texts[place] != text
            ]
            return rewrite(body, changed) if changed else body

        return pd.Series([rebuilt(b, n) for b, n in zip(bodies, fields)], dtype=object)

    return run
