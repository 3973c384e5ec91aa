import re

import pytest
from pyspark.sql import functions as F

from veilmark.functions import longtext
from veilmark.functions.fixed import TOKEN_MAX_BYTES, TOKEN_PATTERN
from veilmark.functions.tokens import find_tokens, make_token, normalize_entity


def tokens(spark, rows, salt="s"):
    df = spark.createDataFrame(rows, "entity string, value string")
    return [r[0] for r in df.select(F.expr(make_token("entity", "value", salt))).collect()]


def test_known_digests(spark):
    rows = [("PERSON", "Jane Doe"), ("EMAIL_ADDRESS", "jane@x.com"), ("PERSON", "José")]
    assert tokens(spark, rows, "salt") == [
        "[[CMPL_PERSON_22b7d4e868371526]]",
        "[[CMPL_EMAIL_ADDRESS_1ba28fb8aa4c90fd]]",
        "[[CMPL_PERSON_6a508319d16ec13a]]",
    ]
    assert tokens(spark, [("PERSON", "Jane Doe")], "s") == [
        "[[CMPL_PERSON_4b03a5e052a5085d]]"
    ]


def test_deterministic_and_sensitive_to_each_part(spark):
    base, again, other_value, other_entity = tokens(
        spark, [("P", "a"), ("P", "a"), ("P", "b"), ("E", "a")]
    )
    assert base == again
    assert len({base, other_value, other_entity, tokens(spark, [("P", "a")], "t")[0]}) == 4
    # the entity is in the label only, not in the digest
    assert base.split("_")[-1] == other_entity.split("_")[-1]


@pytest.mark.parametrize("salt", ["", "it's", "$x", "é\\n", "a\nb"])
def test_any_salt(spark, salt):
    assert tokens(spark, [("P", "v")], salt) == [longtext.token("P", "v", salt)]


LABELS = {
    "weird entity!!": "WEIRD_ENTITY",
    "": "PII",
    "--": "PII",
    " us ssn ": "US_SSN",
    "straße": "STRA_E",
    "ıſx": "ISX",
    "__a__b__": "A__B",
    "\u212a": "PII",
    "ﬁx": "X",
}


def test_labels(spark):
    df = spark.createDataFrame([(k,) for k in LABELS] + [(None,)], "e string")
    got = {r[0]: r[1] for r in df.select("e", F.expr(normalize_entity("e"))).collect()}
    assert got == {**LABELS, None: "PII"}
    assert {k: longtext.label(k) for k in LABELS} == LABELS


def test_tokens_match_their_pattern_and_length(spark):
    made = tokens(spark, [(e, "x") for e in list(LABELS) + ["US_SSN", "EMAIL_ADDRESS"]])
    assert all(re.fullmatch(TOKEN_PATTERN, t) and len(t) <= TOKEN_MAX_BYTES for t in made)


def test_find_tokens(spark):
    a, b = tokens(spark, [("PERSON", "a"), ("URL", "b")])
    rows = [
        (f"x {a}{b} {a}", [a, b, a]),
        ("[[1, 2, 3]]", []),
        ("[[CMPL_PERSON_123]]", []),
        (f"[[CMPL_{a}", [a]),
        ("", []),
        (None, None),
    ]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    got = [r[0] for r in df.select(F.expr(find_tokens("t"))).collect()]
    assert got == [want for _, want in rows]
