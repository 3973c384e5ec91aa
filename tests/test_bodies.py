import json

import pytest
from pyspark.sql import functions as F

from veilmark.functions.longtext import token
from veilmark.operators.bodies import extract_texts, rebuild_bodies, sanitize_requests
from veilmark.options import Options

REGEX = Options(salt="s", backend="regex")
MAIL = "a@b.com"
TOKEN = token("EMAIL_ADDRESS", MAIL, "s")


def requests(spark, bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "body_id bigint, body string")


def upper(spark, body):
    df = requests(spark, [body])
    texts = extract_texts(df).withColumn("text", F.upper("text"))
    return rebuild_bodies(df, texts).first().body


def test_every_role_and_shape_is_read_and_written(spark):
    body = (
        '{"id":7,"tools":["t"],"messages":[{"role":"assistant","content":"Guten Tag"},'
        '{"content":[{"kind":"a","text":"bild"},{"kind":"b","data":"x"},{"text":"unten"}],"n":1}],'
        '"system":[{"text":"regeln","cache":true}],"prompt":"los"}'
    )
    assert upper(spark, body) == (
        '{"id":7,"tools":["t"],"messages":[{"role":"assistant","content":"GUTEN TAG"},'
        '{"content":[{"kind":"a","text":"BILD"},{"kind":"b","data":"x"},{"text":"UNTEN"}],"n":1}],'
        '"system":[{"text":"REGELN","cache":true}],"prompt":"LOS"}'
    )


def test_new_texts_need_an_id_of_one_body(spark):
    df = spark.createDataFrame([(1, '{"prompt":"a"}'), (1, '{"prompt":"b"}'), (None, '{"prompt":"c"}')],
                               "body_id bigint, body string")
    texts = extract_texts(df).withColumn("text", F.upper("text"))
    for wrong in (texts.where("body_id = 1"), texts.where("body_id is null")):
        with pytest.raises(Exception, match="bod"):
            rebuild_bodies(df, wrong).collect()


VERBATIM = [
    "not json at all a@b.com",
    '{"voice":"low","rate":0.25}',
    '{"prompt":"a@b.com","x":1e400}',
    '["a@b.com"]',
    "null",
    '"a@b.com"',
    "",
    None,
    '{"prompt":"a@b.com"} trailing',
    '{"prompt":"a@b.com"},{"prompt":"a@b.com"}',
    '{"prompt":"a@b.com"} [',
    '{"prompt":"a@b.com","x":NaN}',
    '{"messages":"a@b.com","prompt":5,"system":null,"input":{"text":"a@b.com"}}',
    '{"messages":["a@b.com",{"content":{"text":"a@b.com"}},{"content":["a@b.com",{"text":1}]}]}',
    '{ "prompt" : "nothing here" }',
]


@pytest.mark.parametrize("limit", [10, 10**9])
def test_verbatim(spark, limit):
    out = sanitize_requests(requests(spark, VERBATIM), REGEX, long_body_bytes=limit)
    rows = out.orderBy("body_id").collect()
    assert [r.body for r in rows] == VERBATIM
    assert all(r.status == "unchanged" and r.mappings == [] for r in rows)


CHANGED = [
    ('{"prompt":"MAIL"}', '{"prompt":"TOK"}'),
    ('{"prompt":"x","prompt":"MAIL"}', '{"prompt":"x","prompt":"TOK"}'),
    ('{"messages":[{"content":"x"},{"content":"MAIL"}],"messages":[{"content":"MAIL"}]}',
     '{"messages":[{"content":"x"},{"content":"MAIL"}],"messages":[{"content":"TOK"}]}'),
    ('{"input":["MAIL",{"text":"MAIL","n":12345678901234567890}]}',
     '{"input":["MAIL",{"text":"TOK","n":12345678901234567890}]}'),
    ('{"prompt":"a\\u0040b.com é <&>", "f":1.50, "g": 1E2,"h":0.12345678901234567891} ',
     '{"prompt":"TOK é <&>", "f":1.50, "g": 1E2,"h":0.12345678901234567891} '),
    ('{"system":[{"text":"MAIL"}],"messages":[1,{"content":"MAIL"},{"content":[{"text":"MAIL"}]}]}',
     '{"system":[{"text":"TOK"}],"messages":[1,{"content":"TOK"},{"content":[{"text":"TOK"}]}]}'),
    ('{"prompt":"[1] MAIL", "q":"\\"],{:\\\\"}', '{"prompt":"[1] TOK", "q":"\\"],{:\\\\"}'),
    ('{"system":"\\ud800 lone","prompt":"\\ud800 MAIL"}',
     '{"system":"\\ud800 lone","prompt":"\ufffd TOK"}'),
    ('{"prompt":"MAIL","x":' + "[" * 300 + "]" * 300 + "}",
     '{"prompt":"TOK","x":' + "[" * 300 + "]" * 300 + "}"),
]


@pytest.mark.parametrize("limit", [10, 10**9])
def test_changed(spark, limit):
    bodies = [b.replace("MAIL", MAIL) for b, _ in CHANGED]
    out = sanitize_requests(requests(spark, bodies), REGEX, long_body_bytes=limit)
    for r, (_, want) in zip(out.orderBy("body_id").collect(), CHANGED):
        assert r.body == want.replace("MAIL", MAIL).replace("TOK", TOKEN)
        assert {m.token for m in r.mappings} == {TOKEN} and r.status == "redacted"


def test_sanitize_is_one_projection(spark):
    plan = sanitize_requests(requests(spark, VERBATIM), REGEX)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_dictionary_terms_hidden_by_escapes(spark):
    options = Options(salt="s", backend="dictionary", terms={'say "hi"': "QUOTE", "naïve": "WORD"})
    bodies = ['{"prompt":"to say \\"hi\\""}', '{"prompt":"na\\u00efve"}', '{"prompt":"no"}']
    rows = sanitize_requests(requests(spark, bodies), options).orderBy("body_id").collect()
    assert [r.status for r in rows] == ["redacted", "redacted", "unchanged"]


@pytest.mark.parametrize("mode, status", [("open", "passed_uninspected"), ("closed", "rejected")])
def test_custom_detector_and_policy(spark, mode, status):
    def detector(texts, language):
        if any("boom" in t for t in texts):
            raise RuntimeError("no")
        return [[{"entity_type": "P", "start": 0, "end": 1, "score": 1.0}] for _ in texts]

    bodies = ['{"prompt":"abc","system":"boom"}', '{"prompt":"abc"}', "not json boom"]
    out = sanitize_requests(requests(spark, bodies), Options(salt="s", on_error=mode), detector=detector)
    rows = out.orderBy("body_id").collect()
    assert (rows[0].status, rows[0].body) == (status, bodies[0] if mode == "open" else None)
    assert json.loads(rows[1].body)["prompt"] == token("P", "a", "s") + "bc"
    # not a JSON object: verbatim even when failing closed
    assert (rows[2].status, rows[2].body) == ("unchanged", bodies[2])


@pytest.mark.parametrize("mode, status", [("open", "passed_uninspected"), ("closed", "rejected")])
def test_ids_may_be_null_or_repeat_and_a_bad_body_fails_alone(spark, mode, status):
    def detector(texts, language):
        found = []
        for t in texts:
            end = 2**40 if t.startswith("far") else len(t)
            found.append([{"entity_type": "P", "start": 0, "end": end, "score": 1.0}])
        return found

    texts = ["secret A", "secret B", "far", "secret C"]
    rows = [(i, json.dumps({"prompt": t})) for i, t in zip([5, 5, None, None], texts)]
    df = spark.createDataFrame(rows, "body_id bigint, body string").coalesce(1)
    done = sanitize_requests(df, Options(salt="s", on_error=mode), detector=detector)
    out = [(r.body_id, r.status, r.body and json.loads(r.body)["prompt"]) for r in done.collect()]
    want = [(i, "redacted", token("P", t, "s")) for i, t in zip([5, 5, None, None], texts)]
    want[2] = (None, status, "far" if mode == "open" else None)
    assert out == want
