import random

import pytest
from pyspark.sql import functions as F

from tests.test_detect import fuzz_texts
from veilmark.functions import longtext
from veilmark.functions.exprs import FINDINGS
from veilmark.functions.rules import rule_findings, rule_names
from veilmark.functions.spans import redact_text, select_spans, validate_spans
from veilmark.operators import redact as redact_module
from veilmark.operators.redact import (
    extract_mappings,
    redact,
    redact_columns,
    redact_findings,
    redacted,
)
from veilmark.options import Options

REGEX = Options(salt="salt", backend="regex")


def chosen(spark, findings, n):
    df = spark.createDataFrame([(findings,)], f"f {FINDINGS}")
    return [
        (s.start, s.end, s.entity_type)
        for s in df.select(F.explode(F.expr(select_spans("f", str(n))))).select("col.*").collect()
    ]


def test_earliest_start_wins(spark):
    spans = [("C", 11, 14, 0.2), ("B", 4, 30, 0.95), ("A", 3, 11, 0.6)]
    assert chosen(spark, spans, 40) == [(3, 11, "A"), (11, 14, "C")]


def test_ties(spark):
    spans = [("SHORT", 0, 3, 0.9), ("LOW", 0, 5, 0.1), ("HIGH", 0, 5, 0.9),
             ("LATER", 0, 5, 0.9)]
    assert chosen(spark, spans, 20) == [(0, 5, "HIGH")]


def test_bad_spans_are_dropped(spark):
    spans = [("A", -1, 3, 1.0), ("B", 3, 3, 1.0), ("C", 4, 2, 1.0), ("D", 5, 21, 1.0),
             ("E", 18, 20, 1.0)]
    assert chosen(spark, spans, 20) == [(18, 20, "E")]
    df = spark.createDataFrame([(spans,)], f"f {FINDINGS}")
    assert [f.entity_type for f in df.select(F.expr(validate_spans("f", "20"))).first()[0]] == ["E"]


def test_span_choice_against_plain_model(spark):
    rng = random.Random(3)
    cases = []
    for _ in range(300):
        spans = []
        for k in range(rng.randint(0, 12)):
            start = rng.randint(-1, 20)
            spans.append((f"E{k}", start, start + rng.randint(-1, 8), rng.choice([0.1, 0.5, 0.9])))
        cases.append(spans)
    df = spark.createDataFrame(list(enumerate(cases)), f"id int, f {FINDINGS}")
    for r in df.select("id", F.expr(select_spans("f", "22")).alias("s")).collect():
        want = longtext.choose([(a, b, s, e) for e, a, b, s in cases[r.id]], 22)
        assert [(x.start, x.end, x.score, x.entity_type) for x in r.s] == want


def test_names_and_unicode(spark):
    rows = [("Frau Ödön Ünal (unal@firma.de) rief an",), ("🙂🙂 naïve Zoë, ça va?",),
            ("all quiet today",), ("  ",), (None,)]
    terms = {"Ödön Ünal": "PERSON", "unal@firma.de": "EMAIL_ADDRESS", "Zoë": "PERSON"}
    df = spark.createDataFrame(rows, "text string")
    out = redact(df, Options(salt="salt", backend="dictionary", terms=terms)).collect()
    assert out[0].text == (
        "Frau [[CMPL_PERSON_8a099a0fdddc5c34]] "
        "([[CMPL_EMAIL_ADDRESS_4b44cd7b23df990d]]) rief an"
    )
    assert out[1].text == "🙂🙂 naïve [[CMPL_PERSON_ea2d86bc29b328f0]], ça va?"
    assert [r.text for r in out[2:]] == [r[0] for r in rows[2:]]
    assert [r.status for r in out] == ["redacted"] * 2 + ["unchanged"] * 3


def test_rule_edges(spark):
    rows = [("é123-45-6789",), ("https://jane@x.com/1.2.3.4",)]
    out = redact(spark.createDataFrame(rows, "text string"), REGEX).collect()
    assert out[0].text == "é[[CMPL_US_SSN_bb678412ec0376d1]]"
    assert len(out[1].mappings) == 1 and out[1].mappings[0].entity_type == "URL"


def test_both_paths_agree(spark, documents):
    """Expression path, Arrow path and gated path give the same rows."""
    texts = fuzz_texts(1500, 2)
    df = spark.createDataFrame(
        [(-1 - i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"
    ).union(documents)
    plain = redact_text("text", rule_findings("text", rule_names()), "salt")
    out = df.select(
        redacted("text", REGEX).alias("mixed"),
        redacted("text", REGEX, long_text_bytes=0).alias("arrow"),
        redacted("text", REGEX, long_text_bytes=10**9).alias("native"),
        F.expr(plain).alias("ungated"),
    )
    for r in out.collect():
        assert r.mixed == r.arrow == r.native == r.ungated


def test_dense_rows_take_the_arrow_path(spark, monkeypatch):
    found = [("P", i, i + 1, 1.0) for i in range(0, 20, 2)]
    df = spark.createDataFrame([("abcdefghijklmnopqrstuv", found)], f"text string, findings {FINDINGS}")
    native = redact_findings(df, "s").first().redacted
    monkeypatch.setattr(redact_module.longtext, "DENSE_WORK", 0)
    assert redact_findings(df, "s").first().redacted == native
    assert len(native.mappings) == 10


@pytest.mark.parametrize("mode, text, status",
                         [("open", "a b", "passed_uninspected"), ("closed", None, "rejected")])
def test_fail_policy(spark, mode, text, status):
    good = '[{"entity_type":"PERSON","start":0,"end":1,"score":1}]'
    df = spark.createDataFrame(
        [("a b", "broken"), ("a b", good), (None, "broken"), ("a b", "[]")],
        "text string, result_json string",
    )
    out = redact(df, Options(salt="s", on_error=mode)).collect()
    assert (out[0].text, out[0].status, out[0].mappings) == (text, status, [])
    assert out[1].text.startswith("[[CMPL_PERSON_") and out[1].status == "redacted"
    assert (out[2].text, out[2].status) == (None, "unchanged")
    assert (out[3].text, out[3].status) == ("a b", "unchanged")


def test_inspect_backend(spark):
    body = ('{"result":{"findings":[{"infoType":{"name":"PERSON_NAME"},"likelihood":"%s",'
            '"location":{"codepointRange":{"start":"0","end":"3"}}}]}}')
    df = spark.createDataFrame(
        [("Ann x", body % "LIKELY"), ("Ann x", body % "UNLIKELY")], "text string, result_json string"
    )
    options = Options(salt="s", backend="gcpdlp", inspect_project="p")
    out = redact(df, options).collect()
    assert out[0].text.endswith("]] x") and out[1].text == "Ann x"


def test_columns_and_mappings(spark):
    df = spark.createDataFrame([(1, "a@b.com", "x 1.2.3.4 a@b.com"), (2, None, "y")],
                               "id int, a string, b string")
    out = redact_columns(df, REGEX, ["a", "b"])
    rows = out.collect()
    assert [m.value for m in rows[0].mappings] == ["a@b.com", "1.2.3.4", "a@b.com"]
    assert (rows[1].a, rows[1].b) == (None, "y")
    assert extract_mappings(out).count() == 2


def test_plan_has_no_shuffle_and_one_regex_pass(spark, documents):
    stored = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = redact(stored.select("doc_id", "text"), REGEX)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("regexp_extract_all") == len(rule_names())


def test_options_are_checked():
    for bad in ({"ttl_seconds": 0}, {"on_error": "maybe"}):
        with pytest.raises(ValueError):
            Options(salt="s", **bad)


def test_long_term_lists_redact_texts_and_bodies(spark):
    from veilmark.operators.bodies import sanitize_requests

    terms = {f"name{i}x": "PERSON" for i in range(300)}
    options = Options(salt="s", backend="dictionary", terms=terms)
    token = longtext.token("PERSON", "name7x", "s")
    df = spark.createDataFrame([(1, "hi name7x!"), (2, "hi"), (3, None)], "id int, text string")
    assert [r.text for r in redact(df, options).orderBy("id").collect()] == [f"hi {token}!", "hi", None]
    bodies = spark.createDataFrame([(1, '{"prompt":"name7x"}'), (2, "nope"), (3, None)],
                                   "body_id int, body string")
    out = sanitize_requests(bodies, options).orderBy("body_id").collect()
    assert [r.body for r in out] == ['{"prompt":"%s"}' % token, "nope", None]


def test_columns_need_a_backend_that_reads_text_only(spark):
    df = spark.createDataFrame([("Jane Doe",)], "text string")
    with pytest.raises(ValueError):
        redact_columns(df, Options(salt="s"), ["text"])


def test_findings_without_offsets_are_dropped_on_both_paths(spark, monkeypatch):
    df = spark.createDataFrame([("abc", [("P", None, 2, 1.0), ("P", 0, 1, None), ("P", 1, 2, 0.5)])],
                               f"text string, findings {FINDINGS}")
    first = redact_findings(df, "s").first()["redacted"]
    monkeypatch.setattr(longtext, "DENSE_WORK", 0)
    assert redact_findings(df, "s").first()["redacted"] == first and len(first.mappings) == 2


def test_labels_are_cut_to_the_longest_token(spark):
    for entity in ("a" * 500, "é" * 500, "x_" * 300):
        df = spark.createDataFrame([("v", [(entity, 0, 1, 1.0)])], f"text string, findings {FINDINGS}")
        made = redact_findings(df, "s").first()["redacted"].text
        assert made == longtext.token(entity, "v", "s") and len(made) <= 128
