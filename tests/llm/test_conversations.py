"""Conversation repair against plain dynamic programming over whole edit strings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from tests.llm.conftest import SF
from veilmark.llm.conversation_repair import (
    DELETE,
    Repairer,
    Turn,
    damaged,
    repair_report,
    repair_turns,
)

FORM = re.compile(r"(s?(ua)+)?\Z")
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
COLUMNS = "conv_id long, turn long, role string, text string, here string, kind string, edit string"


def cheapest(turns):
    """(cost, edits) by keeping the least (cost, whole string) for each output so far."""

    def close(ways):
        for _ in range(4):
            for out, (cost, edits) in list(ways.items()):
                for role in "ua":
                    new = state(out + role)
                    if new is not None:
                        ways[new] = min(ways.get(new, (9**9, "")), (cost + 5, edits + "I"))
        return ways

    def state(out):
        """The output's shortest equal: what may follow depends on its last role alone."""
        for short in ("", "s", "u", "ua"):
            if re.fullmatch({"": "", "s": "s", "u": "s?(ua)*u", "ua": "s?(ua)+"}[short], out):
                return short
        return None

    ways = close({"": (0, "")})
    for role, doomed, cut in turns:
        new = {}

        def offer(out, cost, edits):
            out = state(out)
            if out is not None:
                new[out] = min(new.get(out, (9**9, "")), (cost, edits))

        for out, (cost, edits) in ways.items():
            offer(out, cost + 2, edits + "D")
            if not doomed:
                offer(out + (role[:1] or "?"), cost + 5 * cut, edits + "K")
                for target in "ua":
                    offer(out + target, cost + 1 + 5 * cut, edits + "R")
        ways = close(new)
    return min(ways[k] for k in ("", "ua") if k in ways)


def exhaustive(turns):
    """Every edit string with at most one insert between turns and two at the end."""
    best = (9**9, "")
    choices = [["D"] if doomed else ["D", "K", "Ru", "Ra"] for _, doomed, _ in turns]
    gaps = ["", "u", "a", "ua", "au"]
    for picked in product(*choices):
        for fill in product(gaps, repeat=len(turns) + 1):
            out, cost, edits = "", 0, ""
            for k, extra in enumerate(fill):
                out, cost, edits = out + extra, cost + 5 * len(extra), edits + "I" * len(extra)
                if k < len(picked):
                    role, _, cut = turns[k]
                    cost += COST[picked[k][0]] + (5 if cut and picked[k] != "D" else 0)
                    edits += picked[k][0]
                    out += {"D": "", "K": role[:1] or "?"}.get(picked[k], picked[k][1:])
            if FORM.match(out):
                best = min(best, (cost, edits))
    return best


def repaired(turns):
    work, edits = Repairer(), ""
    for role, doomed, cut in turns:
        edits += "".join(n.edit for n in work.feed(Turn(0, role, b"x", doomed, cut)))
    edits += "".join(n.edit for n in work.finish())
    return work.cost, edits


def random_turns(rng, count):
    return [
        (rng.choice(["user", "assistant", "system", "", "tool", "User", "agent"]), rng.random() < 0.2, rng.random() < 0.3)
        for _ in range(count)
    ]


def test_against_every_edit_string():
    rng = random.Random(1)
    for _ in range(40):
        turns = random_turns(rng, rng.randint(0, 3))
        assert repaired(turns) == cheapest(turns) == exhaustive(turns)


@pytest.mark.parametrize("seed", range(6))
def test_against_whole_strings(seed):
    rng = random.Random(seed)
    for _ in range(150):
        turns = random_turns(rng, rng.randint(0, 30))
        if seed % 2:  # long runs of one kind keep ways of equal cost apart
            turns = [t for t in turns for _ in range(rng.randint(1, 6))]
        assert repaired(turns) == cheapest(turns)


def test_memory_follows_what_is_uncertain():
    work, most, out = Repairer(), 0, 0
    for k in range(20_000):
        role = "user" if k % 2 == 0 else "assistant"
        out += sum(1 for _ in work.feed(Turn(k, role, b"x.", k % 7 == 3, k % 11 == 5)))
        most = max(most, work.held())
    out += sum(1 for _ in work.finish())
    assert out >= 20_000 and most < 200


def test_a_long_conversation_of_turns_that_must_go():
    """No path is decided before the end, and ties stay comparable."""
    work = Repairer()
    head = [("user", False, False), ("user", False, False)]
    turns = head + [("user", True, False)] * 20_000 + [("assistant", False, False)]
    edits = ""
    for role, doomed, cut in turns:
        edits += "".join(n.edit for n in work.feed(Turn(0, role, b"x", doomed, cut)))
    edits += "".join(n.edit for n in work.finish())
    assert edits.count(DELETE) == 20_001 and work.cost == 40_002


def expected(rows):
    """Reports of damaged conversations, by the definition, in plain Python."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        found[conv]  # a conversation stays without turns
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        found[conv] += [(turn, role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, turns in found.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        seen, marks, counts = set(), [], [0, 0, 0]
        for _, role, text in turns:
            body = text.strip(" \t\n\x0b\x0c\r")
            kind = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if kind is not None:
                counts[kind] += 1
            marks.append((role, kind in (0, 1), kind == 2))
        pairs = zip(turns, turns[1:])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
        cost, audit = cheapest(marks)
        lines, at, state = [], 0, ""
        for edit in audit:
            target = "assistant" if state == "u" else "user"
            if edit == "I":
                lines.append(f"{target}:")
                state = target[0]
                continue
            _, role, text = turns[at]
            at += 1
            if edit != "D":
                role = target if edit == "R" else role
                lines.append(f"{role}:{text}")
                state = role[:1]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return out


AWKWARD = [
    (1, 0, "user", "hello."), (1, 1, "assistant", "hi"), (1, 1, "assistant", "hi"),
    (1, None, "system", None), (1, 5, None, "what?"), (1, 9, "user", "hello."),
    (2, 0, "assistant", "x" * 300_000), (2, 1, "", "é。"), (2, 2, "user", " \t\n"),
    (None, 0, "user", "a."), (None, None, "user", "b!"), (None, 0, "user", "a."),
    (-3, -5, "user", "neg?"), (-3, 4, "assistant", "far \x85"), (7, None, None, None),
] + [(100 + k, t, ["user", "assistant"][t % 2], f"text {t}.") for k in range(40) for t in range(6)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], COLUMNS)


def reports(frame_):
    return {r[0]: tuple(r[1:]) for r in frame_.collect()}


def test_awkward_conversations(spark):
    assert reports(repair_report(damaged(frame(spark, AWKWARD)))) == expected(AWKWARD)


def test_no_rows(spark):
    assert repair_report(damaged(frame(spark, []))).count() == 0
    assert repair_turns(damaged(frame(spark, []))).count() == 0


def test_turns_and_report_agree(spark):
    rows = damaged(frame(spark, AWKWARD))
    turns = defaultdict(list)
    for r in repair_turns(rows).orderBy("conv_id", "position").collect():
        turns[r.conv_id].append(r)
    for conv, (*_, audit, digest) in reports(repair_report(rows)).items():
        assert "".join(t.edit for t in turns[conv]) == audit
        text = "\n".join(f"{t.role}:{t.text}" for t in turns[conv] if t.edit != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == digest


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert reports(repair_report(damaged(table))) == expected(rows)
