"""Toxicity: held-out accuracy, unseen misspellings, defined results for odd rows."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import AWKWARD, documents
from veilmark.llm import toxicity
from veilmark.llm.queries import op12_toxicity

CLEAN = "the river runs past a quiet mill and the old bridge over green water".split()
BAD = ["numbskull", "blockhead"]


def made(count, start=0):
    """Texts of shuffled clean words; every third holds a bad word."""
    rng = np.random.default_rng(start)
    rows = []
    for k in range(start, start + count):
        words = list(rng.choice(CLEAN, 30))
        if k % 3 == 0:
            words[int(rng.integers(30))] = BAD[k % 2]
        rows.append((k, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = made(300)
    docs = documents(spark, rows)
    labels = spark.createDataFrame(
        [(k, int(k % 3 == 0), "x") for k, _ in rows] + [(None, 1, "x"), (5, None, "x")],
        "doc_id long, toxic int, text string",
    )
    return toxicity.train(toxicity.training_passages(docs, labels))


def test_unseen_texts_and_misspellings(model):
    scorer = toxicity.Scorer(model)
    rows = made(300, 1000)
    assert all((scorer.score(t) >= 0.5) == any(b in t for b in BAD) for _, t in rows)
    clean = " ".join(CLEAN)
    for word in ("numbskul", "numbbskull", "blockheads", "blockheadd"):
        assert scorer.score(f"{clean} {word} {clean}") >= 0.5, word
    assert scorer.score(clean) < 0.5


def test_a_long_text_scores_as_its_worst_passage(model):
    scorer = toxicity.Scorer(model)
    long = " ".join(CLEAN * 2000)
    assert scorer.score(long) < 0.5 <= scorer.score(f"{long} numbskull {long}")


def test_odd_rows(spark, awkward, no_documents, model):
    rows = toxicity.score_texts(awkward, model, "doc_id", "fp").collect()
    assert len(rows) == len(AWKWARD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    empty = toxicity.Scorer(model).score("")
    assert empty < 0.5
    by_id = {r.doc_id: r.score for r in rows}
    assert all(math.isclose(by_id[k], empty) for k in (1, 2, 3))
    none = toxicity.score_texts(no_documents, model, "doc_id")
    assert none.columns == ["doc_id", "score", "predicted"] and none.count() == 0


def test_one_label_or_none(spark):
    docs = documents(spark, made(30))
    one = spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, toxic int")
    for labels, want in ((one, 1), (one.where("toxic = 0"), 0)):
        model = toxicity.train(toxicity.training_passages(docs, labels))
        assert {r.predicted for r in toxicity.score_texts(docs, model, "doc_id").collect()} == {want}


def test_sample_is_bounded(spark):
    docs = documents(spark, made(300))
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    sample = toxicity.training_passages(docs, labels, rows=40, limit=25).groupBy("label").count()
    assert {r[0]: r[1] for r in sample.collect()} == {0: 25, 1: 25}


def test_folded_weights_are_the_softmax():
    """The one number a bucket gives what averaging vectors under the softmax gives."""
    words = "some words here".split()
    weights = np.random.default_rng(1).normal(0, 1, toxicity.BUCKETS)
    got = toxicity.Scorer(toxicity.Model(weights, 0.25)).score("Some  words, HERE!")
    mean = np.mean([weights[toxicity.subwords(w)].mean() for w in words])
    assert math.isclose(got, 1 / (1 + math.exp(-(mean + 0.25))))


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = op12_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    found = rows.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in found)
    toxic = [r.predicted for r in found if r.toxic == 1]
    clean = [r.predicted for r in found if r.toxic == 0]
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.1
    documents_ = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows.where(F.col("score").between(0, 1)).count() == documents_.count()
