"""Tool calls: only findings change, through the escapes of every string around them."""

import json
import random

import pytest

from veilmark.functions.fixed import RULE_PATTERNS
from veilmark.functions.longtext import redact_string, rule_matcher, token
from veilmark.functions.toolpatch import patched, unescaped
from veilmark.operators.toolcalls import sanitize_tool_calls
from veilmark.options import Options

MATCH = rule_matcher(RULE_PATTERNS)
MAIL = token("EMAIL_ADDRESS", "a@b.com", "s")
TEXTS = ["a@b.com", "é \"q\" a@b.com\n", "\\ 1.2.3.4 \\u0041", "plain", "", "  ", "🙂 a@b.com ퟿", "{not json a@b.com"]


def write(value, rng):
    """JSON with odd spacing, and escapes that need not be."""
    if isinstance(value, dict):
        pairs = [f"{write(k, rng)}{rng.choice([':', ' : '])}{write(v, rng)}" for k, v in value.items()]
        return "{" + rng.choice(["", " "]) + ", ".join(pairs) + "}"
    if isinstance(value, list):
        return "[" + ",".join(write(v, rng) for v in value) + rng.choice(["", "\n"]) + "]"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=rng.random() < 0.5).replace("/", rng.choice(["/", "\\/"]))
    return json.dumps(value)


def nested(value, level, rng):
    for _ in range(level):
        value = {"x": [1.50, write(value, rng)], "n": 12345678901234567890, "k a@b.com": None}
    return value


def redacted(value):
    if isinstance(value, str):
        try:
            inner = json.loads(value)
        except ValueError:
            inner = None
        if isinstance(inner, (dict, list)):
            return redacted(inner)
        return redact_string(value, MATCH(value), "s")[0]
    if isinstance(value, dict):
        return {k: redacted(v) for k, v in value.items()}
    return [redacted(v) for v in value] if isinstance(value, list) else value


def opened(value):
    """The value with inner documents read."""
    if isinstance(value, str):
        try:
            inner = json.loads(value)
        except ValueError:
            return value
        return opened(inner) if isinstance(inner, (dict, list)) else value
    if isinstance(value, dict):
        return {k: opened(v) for k, v in value.items()}
    return [opened(v) for v in value] if isinstance(value, list) else value


@pytest.mark.parametrize("level", [0, 1, 2, 3])
def test_every_level(level):
    rng = random.Random(level)
    for _ in range(60):
        held = {"a": rng.choice(TEXTS), "b": [rng.choice(TEXTS), {"c": rng.choice(TEXTS)}]}
        arguments = nested(held, level, rng)
        body = write({"method": "tools/call", "params": {"name": "a@b.com", "arguments": arguments}, "id": 1}, rng)
        new, mappings = patched(body, MATCH, "s")
        got, want = json.loads(new), json.loads(body)
        assert got["params"]["name"] == "a@b.com"
        assert opened(got["params"]["arguments"]) == redacted(want["params"]["arguments"])
        # putting the values back gives the very bytes that came in
        for m in mappings:
            new = new.replace(m["token"], m["value"])
        assert new == body


def test_positions_of_escapes():
    raw = '"a\\n\\u00e9\\ud83d\\ude42\\/b"'
    text, places = unescaped(raw)
    assert text == json.loads(raw) and len(places) == len(text) + 1
    assert [raw[a:b] for a, b in zip(places, places[1:])] == ["a", "\\n", "\\u00e9", "\\ud83d\\ude42", "\\/", "b"]


def test_where_strings_are_inspected(spark):
    inner = json.dumps({"to": "a@b.com"})
    bodies = {
        "call": {"method": "tools/call", "params": {"name": "x", "arguments": {"to": "a@b.com"}}},
        "other": {"method": "tools/list", "params": {"arguments": {"to": "a@b.com"}}},
        "result": {"id": 1, "result": {"content": [{"type": "text", "text": inner}, 7], "note": "a@b.com"}},
        "structured": {"result": {"structuredContent": {"deep": [["a@b.com"]]}}},
        "chat": {"messages": [{"role": "tool", "content": inner}, {"role": "user", "content": "a@b.com"},
                              {"tool_calls": [{"function": {"name": "f", "arguments": inner}}]}, "x"]},
        "batch": [{"method": "tools/call", "params": {"arguments": {"to": "a@b.com"}}}, 5, {"method": "x", "to": "a@b.com"}],
    }
    hits = {"call": 1, "other": 0, "result": 1, "structured": 1, "chat": 2, "batch": 1}
    rows = [(k, json.dumps(v)) for k, v in bodies.items()]
    rows += [("none", None), ("text", "tool a@b.com {"), ("empty", ""), ("array", "[]"), ("twice", '{"result":{"content":[{"text":"a@b.com"}]},"result":1}')]
    done = {r.body_id: r for r in sanitize_tool_calls(spark.createDataFrame(rows, "body_id string, body string"), Options(salt="s", backend="regex")).collect()}
    for name, body in rows:
        count = hits.get(name, 0)
        got = done[name]
        assert len(got.mappings) == count and got.status == ("redacted" if count else "unchanged")
        assert (got.body or "").replace(MAIL, "a@b.com") == (body or "") and (got.body is None) == (body is None)
        assert (got.body or "").count(MAIL) == count


def test_positions_are_worked_out_only_for_findings(monkeypatch):
    from veilmark.functions import toolpatch

    def body(text):
        return json.dumps({"method": "tools/call", "params": {"arguments": {"to": json.dumps({"t": f'é"\n{text}'})}}})

    asked = []
    monkeypatch.setattr(toolpatch, "unescaped", lambda raw: asked.append(raw) or unescaped(raw))
    match = rule_matcher(["EMAIL_ADDRESS"])
    assert patched(body("none"), match, "s") == (body("none"), []) and not asked
    new, found = patched(body("a@b.com"), match, "s")
    assert new.replace(found[0]["token"], "a@b.com") == body("a@b.com") and len(asked) == 2
