"""Tool calls and tool results in request and response bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions.exprs import MAPPINGS, text_literal
from veilmark.functions.toolpatch import patch_tools_udf
from veilmark.operators.bodies import _with_policy
from veilmark.operators.redact import TextRules, reads_text_only
from veilmark.options import Options

# fixed values: a body without any of them holds no tool call
MARKS = ("tools/call", "tools\\/call", "result", "tool_calls", "tool")


def sanitize_tool_calls(requests: DataFrame, options: Options, body: str = "body") -> DataFrame:
    """Redact the strings of tool calls and their results.

    Inspected are all strings, at any depth, of ``params.arguments`` of a ``tools/call``, of a
    ``result``'s content texts and structured content, of ``tool_calls[].function.arguments``
    in chat messages and of messages with role ``tool``; a batch is a list of bodies.  A string
    that is itself a JSON object or array is inspected by its own strings, down to eight
    levels.  Keys, numbers and everything else stay, byte for byte.  Adds ``mappings``,
    ``detect_error`` and ``status`` as ``sanitize_requests`` does; a body that is not JSON is
    ``unchanged``.  Tokens are those of ``redact``, so ``rehydrate`` restores a body as text.

    One projection: bodies that cannot hold a finding or a tool call never reach Python.
    """
    if not reads_text_only(options):
        raise ValueError("tool calls need the regex or the dictionary backend")
    rules = TextRules(options)
    hidden = f"contains({body}, {text_literal(chr(92))})"  # an escape may hide what rules look for
    marked = " OR ".join(f"contains({body}, {text_literal(m)})" for m in dict.fromkeys(MARKS))
    suspicious = f"coalesce(({rules.gate(body)} OR {hidden}) AND ({marked}), false)"
    done = patch_tools_udf(rules.match, options.salt)(F.expr(f"CASE WHEN {suspicious} THEN {body} END"))
    staged = requests.withColumns({"_patched": done, "_mappings": F.lit(None).cast(MAPPINGS)})
    return _with_policy(staged, options, body)
