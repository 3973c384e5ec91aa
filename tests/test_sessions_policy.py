"""Salts by session and time, actions by place and entity, requests with their answers."""

import random

import pytest
from pyspark.sql import functions as F

from veilmark.functions.longtext import token
from veilmark.operators.policy import redact_by_policy, resolve_policies
from veilmark.operators.redact import redact
from veilmark.operators.sessions import (
    NO_SALT,
    redact_sessions,
    rehydrate_sessions,
    session_vault,
    with_salts,
)
from veilmark.options import Options
from veilmark.streaming.transactions import restore_transactions

OPTIONS = Options(salt="s", backend="regex")
REQUESTS = "id int, session_id string, ts timestamp_ntz, text string"
SALTS = "session_id string, salt_version int, salt string, valid_from timestamp_ntz"


def frame(spark, rows, schema):
    plain = spark.createDataFrame(rows, schema.replace("timestamp_ntz", "string"))
    times = {c.split()[0]: F.col(c.split()[0]).cast("timestamp") for c in schema.split(", ") if "timestamp" in c}
    return plain.withColumns(times)


def moment(hour):
    return f"2026-01-{1 + hour // 24:02d} {hour % 24:02d}:00:00"


def test_salts_as_of_a_moment_against_search(spark):
    rng = random.Random(4)
    salts = [(rng.choice(["a", "b", "c"]), k, f"salt{k}", moment(rng.randint(0, 300))) for k in range(40)]
    salts.append(("a", 99, "later", salts[0][3] if salts[0][0] == "a" else moment(5)))
    asked = [(k, rng.choice(["a", "b", "c", "d", None]), rng.choice([moment(rng.randint(0, 320)), None]), "x") for k in range(200)]
    got = {r.id: (r.salt_version, r.salt) for r in with_salts(frame(spark, asked, REQUESTS), frame(spark, salts, SALTS)).collect()}
    assert len(got) == 200
    for k, session, ts, _ in asked:
        held = [s for s in salts if s[0] == session and ts and s[3] <= ts]
        best = max(held, key=lambda s: (s[3], s[1]), default=(None,) * 4)
        assert got[k] == (best[1], best[2])


def test_a_value_has_another_token_in_each_session_and_after_a_rotation(spark):
    salts = frame(spark, [("a", 0, "s0", moment(0)), ("a", 1, "s1", moment(10)), ("b", 0, "t0", moment(0))], SALTS)
    text = "mail a@b.com, card 4111 1111 1111 1111"
    asked = [(1, "a", moment(1), text), (2, "a", moment(10), text), (3, "b", moment(1), text),
             (4, "c", moment(1), text), (5, "c", moment(1), "plain"), (6, None, moment(1), text), (7, "a", moment(2), None),
             (8, "a", moment(1), "a@b.co " * 30_000)]
    done = {r.id: r for r in redact_sessions(frame(spark, asked, REQUESTS), salts, OPTIONS).collect()}
    assert [done[k].text.split()[1].rstrip(",") for k in (1, 2, 3)] == [
        token("EMAIL_ADDRESS", "a@b.com", s) for s in ("s0", "s1", "t0")]
    assert done[8].text.split()[0] == token("EMAIL_ADDRESS", "a@b.co", "s0") and len(done[8].mappings) == 30_000
    assert done[4].status == done[6].status == "passed_uninspected" and done[4].detect_error == NO_SALT
    assert done[5].status == "unchanged" and done[7].text is None
    closed = redact_sessions(frame(spark, asked[3:4], REQUESTS), salts, Options(salt="", backend="regex", on_error="closed"))
    assert [(r.text, r.status) for r in closed.collect()] == [(None, "rejected")]


def test_sessions_restore_their_own_tokens_alone(spark):
    salts = frame(spark, [("a", 0, "s0", moment(0)), ("a", 1, "s1", moment(10)), ("b", 0, "t0", moment(0))], SALTS)
    asked = frame(spark, [(1, "a", moment(1), "x a@b.com"), (2, "a", moment(11), "y a@b.com"), (3, "b", moment(1), "z a@b.com")], REQUESTS)
    done = redact_sessions(asked, salts, OPTIONS)
    texts = {r.id: r.text for r in done.collect()}
    both = " | ".join(texts.values())
    answers = spark.createDataFrame(
        [("a", both), ("b", both), ("c", both), (None, both), ("a", None), ("a", "none")], "session_id string, text string")
    vault = session_vault(done, 3600, moment(0))
    out = {}
    for r in rehydrate_sessions(answers, vault, now=moment(0)).collect():
        out.setdefault(r.session_id, []).append(r.text)
    assert sorted(map(str, out["a"])) == ["None", "none", f"x a@b.com | y a@b.com | {texts[3]}"]
    assert out["b"] == [f"{texts[1]} | {texts[2]} | z a@b.com"]
    assert out["c"] == out[None] == [both]


POLICIES = "namespace string, route string, entity_type string, action string"


def resolved(spark, rules, places):
    places = spark.createDataFrame(places, "namespace string, route string")
    rows = resolve_policies(places, spark.createDataFrame(rules, POLICIES)).collect()
    return {(r.namespace, r.route): r.actions for r in rows}


def test_precedence(spark):
    rules = [
        ("*", "", "*", "audit"), ("*", "/v1/chat", "EMAIL", "mask"), ("n", "", "EMAIL", "tokenize"),
        ("n", "/v1", "EMAIL", "audit"), ("n", "/v1/", "EMAIL", "block"), ("*", "/v1/chat/x", "*", "block"),
    ]
    got = resolved(spark, rules, [("n", "/v1/chat/x"), ("n", "/v10"), ("m", "/v1/chat"), ("m", "/v1/chatter"), (None, None), ("n", None), ("m", "/v1/chat")])
    # a namespace of its own goes before a longer route, equal rules take the strictest
    assert got["n", "/v1/chat/x"] == {"EMAIL": "block", "*": "block"}
    assert got["n", "/v10"] == {"EMAIL": "tokenize", "*": "audit"}
    assert got["m", "/v1/chat"] == {"EMAIL": "mask", "*": "audit"}
    assert got["m", "/v1/chatter"] == got[None, None] == {"*": "audit"}
    assert got["n", None] == {"EMAIL": "tokenize", "*": "audit"}


@pytest.mark.parametrize("rule", [("*", "", "*", "shred"), (None, "", "*", "mask"), ("*", None, "*", "mask"), ("*", "", "*", None)])
def test_wrong_policies_are_an_error(spark, rule):
    with pytest.raises(Exception, match="unknown action"):
        resolved(spark, [rule, ("*", "", "*", "mask")], [("n", "/v1")])


def test_actions(spark):
    rules = [("t", "", "*", "tokenize"), ("m", "", "*", "mask"), ("m", "", "IP_ADDRESS", "audit"), ("b", "", "IP_ADDRESS", "block"), ("a", "", "*", "audit")]
    text = "é a@b.com, 1.2.3.4!"
    rows = [(n, "/x", text) for n in "tmbaz"] + [("t", "/x", None), ("t", "/x", ""), ("b", "/x", "only a@b.com")]
    asked = spark.createDataFrame(rows, "namespace string, route string, text string")
    done = redact_by_policy(asked, spark.createDataFrame(rules, POLICIES), OPTIONS, default="mask").collect()
    by = {(r.namespace, (rows[k][2])): r for r in done for k in range(len(rows)) if rows[k][0] == r.namespace and (r.namespace != "b" or (r.status == "blocked") == (rows[k][2] == text))}
    mail, address = token("EMAIL_ADDRESS", "a@b.com", "s"), token("IP_ADDRESS", "1.2.3.4", "s")
    texts = sorted((r.namespace, str(r.text), r.status, len(r.mappings), len(r.audit)) for r in done)
    assert texts == sorted([
        ("t", f"é {mail}, {address}!", "redacted", 2, 2), ("m", "é <EMAIL_ADDRESS>, 1.2.3.4!", "redacted", 0, 2),
        ("b", "None", "blocked", 0, 2), ("a", text, "audited", 0, 2),
        ("z", "é <EMAIL_ADDRESS>, <IP_ADDRESS>!", "redacted", 0, 2),
        ("t", "None", "unchanged", 0, 0), ("t", "", "unchanged", 0, 0), ("b", "only <EMAIL_ADDRESS>", "redacted", 0, 1)])
    assert by and all("a@b.com" not in str(r.audit) for r in done)


def test_policy_errors(spark):
    asked = spark.createDataFrame([("n", "/", "a@b.com")], "namespace string, route string, text string")
    rules = spark.createDataFrame([("*", "", "*", "mask")], POLICIES)
    with pytest.raises(ValueError):
        redact_by_policy(asked, rules, OPTIONS, default="shred")

    def detector(texts, language):
        raise RuntimeError("no")

    for mode, want in (("open", ("a@b.com", "passed_uninspected")), ("closed", (None, "rejected"))):
        done = redact_by_policy(asked, rules, Options(salt="s", backend="regex", on_error=mode), detector=detector)
        assert [(r.text, r.status) for r in done.collect()] == [want]


def test_transactions_on_tables(spark):
    asked = frame(spark, [(1, moment(0), "a@b.com é@x.com"), (1, moment(0), "a@b.com é@x.com"), (2, moment(0), "c@d.com"), (3, moment(0), "none")],
                  "request_id bigint, ts timestamp_ntz, text string")
    redacted = redact(asked, OPTIONS)
    one, two = token("EMAIL_ADDRESS", "a@b.com", "s"), token("EMAIL_ADDRESS", "c@d.com", "s")
    body = f"é {one} {two}".encode()
    rows = [(1, 0, body, moment(0)), (2, 0, body, moment(0)), (1, 1, b"\xff" + one.encode(), moment(1)), (1, 2, one.encode(), moment(2)),
            (9, 0, body, moment(0)), (None, 0, body, moment(0))]
    answers = frame(spark, rows, "request_id bigint, seq bigint, chunk binary, ts timestamp_ntz").withColumn("chunk", F.col("chunk").cast("binary"))
    out = {(r.request_id, r.seq, r.status): r.chunk and bytes(r.chunk) for r in restore_transactions(redacted, answers).collect()}
    assert out == {
        (1, 0, "restored"): f"é a@b.com {two}".encode(), (2, 0, "restored"): f"é {one} c@d.com".encode(),
        (1, 1, "restored"): b"\xffa@b.com", (1, 2, "no_request"): one.encode(),
        (9, 0, "no_request"): body, (None, 0, "no_request"): body, (3, None, "no_response"): None}
