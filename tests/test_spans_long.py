"""The choice of spans on a table against the choice in arrays."""

import random

import pytest
from pyspark.sql import functions as F

from veilmark.functions.longtext import choose
from veilmark.operators.spans_long import islands, select_spans_long

SCHEMA = "doc string, entity_type string, start int, end int, score double, ord int, size int"


def crowd(rng, count, size, longest):
    rows = []
    for k in range(count):
        start = rng.randint(-2, size)
        end = start + rng.choice([0, 1, 1, 2, 3, rng.randint(0, longest)])
        score = rng.choice([None, 0.5, 0.5, 0.9])
        rows.append((rng.choice(["A", "B"]), rng.choice([start, start, None]) if rng.random() < 0.02 else start, end, score, k))
    return rows


@pytest.mark.parametrize("positions", [1, 7, 64, 1 << 16])
def test_against_arrays(spark, positions):
    rng = random.Random(positions)
    docs = {f"d{k}": (crowd(rng, rng.randint(0, 120), 150, rng.choice([3, 40])), 140) for k in range(20)}
    docs[None] = (crowd(rng, 50, 60, 9), 60)
    rows = [(d, e, a, b, s, o, n) for d, (found, n) in docs.items() for e, a, b, s, o in found]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in select_spans_long(frame, "doc", "ord", "size", positions).collect():
        got.setdefault(r.doc, []).append((r.start, r.end, r.score, r.entity_type))
    for d, (found, n) in docs.items():
        want = choose([(a, b, s, e) for e, a, b, s, _ in found], n)
        assert sorted(got.get(d, []), key=lambda s: s[0]) == want


def test_one_document_with_very_many_findings(spark):
    """A third of a million findings of one text, as many islands."""
    rows = spark.range(300_000).select(
        F.lit("d").alias("doc"), F.lit("A").alias("entity_type"),
        (F.col("id") * 3).cast("int").alias("start"), (F.col("id") * 3 + 5).cast("int").alias("end"),
        F.lit(0.5).alias("score"),
    )
    apart = rows.where("start % 30 < 12")  # islands of four
    assert select_spans_long(rows, "doc", positions=1 << 12).count() == 150_000
    done = select_spans_long(apart, "doc", positions=1 << 12)
    assert done.count() == 60_000
    assert islands(apart, ["doc"], 1 << 12).select("_island").distinct().count() == 30_000


def test_no_findings(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert select_spans_long(empty, ["doc", "size"]).count() == 0
