import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.functions import longtext
from veilmark.functions.entities import canonical_entity, likelihood_score
from veilmark.functions.fixed import RULE_PATTERNS
from veilmark.functions.rules import gate, rule_findings, rule_names
from veilmark.operators.detect import (
    check_backend,
    detect,
    detect_dictionary,
    detect_regex,
    detect_with,
    findings_long,
    ingest_analyzer_findings,
    ingest_inspect_findings,
)
from veilmark.operators.terms import detect_terms
from veilmark.options import Options


def found(spark, text, entities=None):
    df = spark.createDataFrame([(text,)], "text string")
    return [
        (r.entity_type, text[r.start : r.end])
        for r in findings_long(detect_regex(df, entities=entities)).collect()
    ]


def test_offsets_are_code_points(spark):
    assert found(spark, "café → 🙂 mail jane@acme.com now") == [
        ("EMAIL_ADDRESS", "jane@acme.com")
    ]


def test_allowlist(spark):
    text = "ssn 123-45-6789 mail a@b.com"
    assert found(spark, text, ["US_SSN"]) == [("US_SSN", "123-45-6789")]
    assert found(spark, text, ["PERSON"]) == []
    assert len(found(spark, text, [])) == 2


@pytest.mark.parametrize(
    "text, want",
    [
        ("é123-45-6789", [("US_SSN", "123-45-6789")]),
        ("1123-45-6789", []),
        ("中192.168.0.1文", [("IP_ADDRESS", "192.168.0.1")]),
        ("1.2.3.4.5", [("IP_ADDRESS", "1.2.3.4")]),
        ("http://a\x0bb", [("URL", "http://a\x0bb")]),
        ("xhttp://a.b", []),
        ("(555) 123-4567", []),
        ("+1 (743) 555-3824", [("PHONE_NUMBER", "1 (743) 555-3824")]),
        ("a(555) 123-4567", [("PHONE_NUMBER", "(555) 123-4567")]),
        ("1234 5678-90123456", [("CREDIT_CARD", "1234 5678-90123456")]),
        ("12345678901234567", []),
        ("a@b.co1x@y.com", [("EMAIL_ADDRESS", "a@b.co"), ("EMAIL_ADDRESS", "1x@y.com")]),
        ("a@b@c.com", [("EMAIL_ADDRESS", "b@c.com")]),
    ],
)
def test_rule_edges(spark, text, want):
    assert found(spark, text) == want


def python_model(text):
    spans = []
    for order, (rule, pattern) in enumerate(RULE_PATTERNS.items()):
        pattern = pattern.replace(r"[^\s]", r"[^\t\n\f\r ]")
        for m in re.finditer(pattern, text, re.ASCII):
            spans.append((m.start(), order, rule, m.end()))
    return [(rule, start, end) for start, _, rule, end in sorted(spans)]


def fuzz_texts(n, seed):
    rng = random.Random(seed)
    atoms = (
        ["a@b.com", "123-45-6789", "1234-5678-9012-3456", "(555) 123-4567", "1.2.3.4",
         "http://", "https://x.y", "@", ".", "-", " ", "+", "(", ")", "é", "中", "🙂",
         "_", "x", "7", "42", "555", "1234", "25", "256.", "\n", "\t", "\x0b", "\xa0",
         "co", "[[CMPL_URL_", "]]", "\u0085", "%", "com"]
    )
    return ["".join(rng.choices(atoms, k=rng.randint(0, 14))) for _ in range(n)]


def test_fuzz_against_plain_model(spark):
    texts = fuzz_texts(4000, 1)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = detect_regex(df).select(
        "id",
        "findings",
        F.expr(rule_findings("text", rule_names())).alias("ungated"),
        F.expr(gate("text", rule_names())).alias("gate"),
    )
    match = longtext.rule_matcher(rule_names())
    hits = 0
    for r in out.collect():
        want = python_model(texts[r.id])
        assert [(f.entity_type, f.start, f.end) for f in r.findings] == want, texts[r.id]
        assert r.ungated == r.findings
        assert [(s[3], s[0], s[1]) for s in match(texts[r.id])] == want
        assert r.gate or not want
        hits += bool(want)
    assert hits > 1000


def test_long_unbroken_runs_stay_linear(spark):
    text = "a" * 2_000_000 + " 1" + "2" * 500_000
    df = spark.createDataFrame([(text + " @",), (text + "@b.com",)], "text string")
    sizes = [r[0] for r in detect_regex(df).select(F.size("findings")).collect()]
    assert sizes == [0, 1]


def test_dictionary_finds_overlapping_occurrences(spark):
    terms = {"aa": "X", "aab": "Y", "É.": "Z", "\\E": "Q", "it's $1": "W"}
    texts = ["aaaab", "É. aa É.", "x\\Ey", "", "so it's $1 aa", "É.É."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    match = longtext.term_matcher(terms, 0.9)
    for r in detect_dictionary(df, terms).collect():
        got = sorted((f.start, f.end, f.score, f.entity_type) for f in r.findings)
        assert got == sorted(match(texts[r.id])), texts[r.id]
    assert len(match("aaaab")) == 4


def test_backends():
    for backend, kwargs in [("", {}), ("presidio", {}), ("regex", {}),
                            ("gcpdlp", {"inspect_project": "p"})]:
        check_backend(Options(salt="s", backend=backend, **kwargs))
    assert check_backend(Options(salt="s", backend="")) == "presidio"
    for backend in ("gcpdlp", "bogus", "dictionary"):
        with pytest.raises(ValueError):
            check_backend(Options(salt="s", backend=backend))


def test_detect_needs_its_result_column(spark):
    df = spark.createDataFrame([("x",)], "text string")
    with pytest.raises(ValueError):
        detect(df, Options(salt="s"))


ANALYZER = [
    ('[{"entity_type":"PERSON","start":1,"end":4,"score":0.85}]', 1),
    ("[]", 0),
    ("null", 0),
    ("[{}]", 1),
    ("[null]", 1),
    ('[{"entity_type":"P","start":1,"end":2,"score":1,"extra":{}}] tail', 1),
    ('[{"start":"1"}]', None),
    ('[{"start":1.5}]', None),
    ('[{"entity_type":7}]', None),
    ("{}", None),
    ("[1]", None),
    ("[{", None),
    ("", None),
]


def test_ingest_analyzer(spark):
    df = spark.createDataFrame([(j,) for j, _ in ANALYZER], "json string")
    rows = ingest_analyzer_findings(df).collect()
    for r, (_, n) in zip(rows, ANALYZER):
        assert (None if r.findings is None else len(r.findings)) == n, r.json
        assert (r.detect_error is None) == (n is not None), r.json
    assert tuple(rows[0].findings[0]) == ("PERSON", 1, 4, 0.85)
    assert tuple(rows[3].findings[0]) == ("", 0, 0, 0.0)


def inspect(start, end, name="PERSON_NAME", likelihood="LIKELY"):
    rng = {k: v for k, v in (("start", start), ("end", end)) if v != "absent"}
    return json.dumps(
        {"result": {"findings": [{"infoType": {"name": name}, "likelihood": likelihood,
                                  "location": {"codepointRange": rng}}]}}
    )


def test_ingest_inspect(spark):
    cases = [
        (inspect("5", 9), [("PERSON", 5, 9, 0.7)]),
        (inspect("absent", "+9"), [("PERSON", 0, 9, 0.7)]),
        (inspect(None, ""), [("PERSON", 0, 0, 0.7)]),
        (inspect(1, 2, "PASSPORT", "POSSIBLE"), [("PASSPORT", 1, 2, 0.5)]),
        (inspect(1, 2, "URL", "UNLIKELY"), []),
        (inspect(1, 2, "URL", "WHATEVER"), [("URL", 1, 2, 0.5)]),
        ('{"result":{}}', []),
        ("{}", []),
        ('{"result":{"findings":null}}', []),
        (inspect("x", 2), None),
        (inspect(1.5, 2), None),
        (inspect(True, 2), None),
        ('{"result":[]}', None),
        ('{"result":{"findings":[5]}}', None),
        ("[]", None),
        ("nope", None),
    ]
    df = spark.createDataFrame([(j,) for j, _ in cases], "json string")
    for r, (_, want) in zip(ingest_inspect_findings(df, threshold=0.5).collect(), cases):
        got = None if r.findings is None else [tuple(f) for f in r.findings]
        assert got == want, r.json
        assert (r.detect_error is None) == (want is not None), r.json


def test_ingest_allowlist_is_strict(spark):
    df = spark.createDataFrame([(inspect(1, 2, "PASSPORT"),)], "json string")
    row = ingest_inspect_findings(df, entities=["CRYPTO"]).first()
    assert row.findings == [] and row.detect_error is None


def test_names_and_scores(spark):
    df = spark.createDataFrame(
        [("US_SOCIAL_SECURITY_NUMBER", "VERY_LIKELY"), ("PASSPORT", "VERY_UNLIKELY"),
         ("PERSON_NAME", None)], "n string, l string")
    rows = df.select(F.expr(canonical_entity("n")), F.expr(likelihood_score("l"))).collect()
    assert [tuple(r) for r in rows] == [("US_SSN", 0.9), ("PASSPORT", 0.1), ("PERSON", 0.5)]


def test_custom_detector_isolates_failures(spark):
    def detector(texts, language):
        assert language == "de"
        if any("boom" in t for t in texts):
            raise RuntimeError("no")
        return [[{"entity_type": "FIRST", "start": 0, "end": 1, "score": 0.6}]] * len(texts)

    texts = ["a", None, "  ", "boom", "b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    rows = detect_with(df, detector, language="de").collect()
    assert [len(r.findings) if r.findings is not None else None for r in rows] == [1, 0, 0, None, 1]
    assert [bool(r.detect_error) for r in rows] == [False, False, False, True, False]


def test_long_term_lists(spark):
    terms = {f"t{i}é": f"E{i % 3}" for i in range(400)} | {"🙂t": "F", "aa": "A", "a": "B"}
    texts = ["x t7é t399ét7é", "🙂🙂t1é", "aaa", None, "", "none"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    few = longtext.term_matcher(dict(list(terms.items())[-3:]), 0.9)
    for r in detect_dictionary(df, terms).collect():
        if texts[r.id] is None:
            assert r.findings is None
            continue
        got = sorted((f.start, f.end, f.score, f.entity_type) for f in r.findings)
        want = [
            (m.start(), m.end(), 0.9, terms[m.group()])
            for m in re.finditer("t[0-9]+é", texts[r.id])
        ] + few(texts[r.id])
        assert got == sorted(want)


def test_dense_texts_take_time_in_proportion_to_their_matches(spark):
    import time

    def seconds(count):
        df = spark.createDataFrame([("a@b.co " * count,)], "text string")
        started = time.perf_counter()
        assert detect_regex(df).select(F.size("findings")).first()[0] == count
        return time.perf_counter() - started

    seconds(40_000)
    assert seconds(40_000) < 10


def test_terms_of_a_table_against_search(spark):
    rng = random.Random(8)
    letters = "aábü🙂 "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    terms = {word(rng.choice([1, 2, 3, 4, 5, 9])): rng.choice(["P", "Q"]) for _ in range(60)}
    texts = [word(rng.randint(0, 80)) for _ in range(60)] + [None, "", "aá" * 40]
    texts += texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame([*terms.items(), (None, "P"), ("", "P")], "term string, entity_type string")
    for r in detect_terms(df, table).collect():
        text = texts[r.id]
        got = None if r.findings is None else [(f.start, f.end, f.entity_type) for f in r.findings]
        want = None if text is None else sorted(
            (k, k + len(t), e) for t, e in terms.items()
            for k in range(len(text)) if text.startswith(t, k)
        )
        assert got == want and r.detect_error is None
    assert detect_terms(df, table.where("false")).where("size(findings) > 0").count() == 0


def test_terms_with_one_shared_beginning_take_time_in_proportion(spark):
    """100,000 terms begin alike; each text holds one of them and a near miss."""
    import time

    terms = spark.range(100_000).select(
        F.format_string("Customer#%09d", "id").alias("term"), F.lit("PERSON").alias("entity_type")
    )

    def seconds(count):
        texts = spark.range(count).select(
            "id", F.format_string("to Customer#%09d, Customer#9%08d", F.col("id") % 100_000, "id").alias("text")
        )
        started = time.perf_counter()
        found = detect_terms(texts, terms).agg(F.sum(F.size("findings"))).first()[0]
        assert found == count
        return time.perf_counter() - started

    seconds(1000)
    few, many = seconds(20_000), seconds(80_000)
    assert many < 5 * few + 5


def test_long_lists_are_found_in_rows_too():
    terms = {f"t{i}é": f"E{i % 3}" for i in range(400)} | {"🙂t": "F", "aa": "A"}
    match = longtext.term_matcher(terms, 0.9)
    assert sorted(match("aaa t7é🙂t399é")) == [
        (0, 2, 0.9, "A"), (1, 3, 0.9, "A"), (4, 7, 0.9, "E1"), (7, 9, 0.9, "F"), (8, 13, 0.9, "E0")]


def test_windows_of_many_texts_are_hashed_together(monkeypatch):
    from veilmark.functions import windows

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("aábü🙂 ") for _ in range(n))
    terms = {word(rng.choice([1, 2, 3, 7])) for _ in range(30)}
    texts = [word(rng.randint(0, 40)) for _ in range(200)] + [None, "", "ab"]
    sizes, bits = sorted({len(t) for t in terms}), windows.bitmap_bits(len(terms))
    bitmap = windows.bitmap_of(terms, bits)
    alone = [[] if t is None else list(windows.candidates(t, bitmap, sizes, bits)) for t in texts]
    hashed = []
    monkeypatch.setattr(windows, "RunningHash", lambda t, make=windows.RunningHash: hashed.append(t) or make(t))
    assert windows.candidates_of(texts, bitmap, sizes, bits) == alone and len(hashed) == 1
    assert windows.candidates_of([], bitmap, sizes, bits) == [] == windows.candidates_of([], bitmap, [], bits)
    assert list(windows.text_runs(np.array([3, 3, 9, 0, 1]), 6)) == [(0, 2), (2, 3), (3, 5)]
