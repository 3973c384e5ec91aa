"""Request tables: each source format, and what the writers leave."""

import pytest

from veilmark.operators.bodies import sanitize_requests
from veilmark.options import Options
from veilmark.sources.tables import read_requests, write_rejected, write_requests

BODIES = ['{"prompt":"mail a@b.com"}', "not json", '{"prompt":"b@c.com"}']
REGEX = Options(salt="s", backend="regex")


@pytest.mark.parametrize("format", ["parquet", "json", "orc"])
def test_tables(spark, work, format):
    df = spark.createDataFrame(list(enumerate(BODIES)), "body_id bigint, body string")
    df.write.format(format).save(f"{work}/in")
    got = read_requests(spark, f"{work}/in", format).orderBy("body_id").collect()
    assert [tuple(r) for r in got] == list(enumerate(BODIES))


def test_lines_of_a_file_have_ids_of_their_own(spark, work):
    with open(f"{work}/in.txt", "w") as file:
        file.write("\n".join(BODIES + BODIES[:1]))
    lines = read_requests(spark, f"{work}/in.txt", "text")
    ids = [r.body_id for r in lines.collect()]
    assert len(ids) == 4 and len(set(ids)) == 3
    done = {r.body_id: r.body for r in sanitize_requests(lines, REGEX).collect()}
    assert len(set(done.values())) == 3 and "not json" in done.values()
    whole = read_requests(spark, f"{work}/in.txt", "text", wholetext="true").collect()
    assert len(whole) == 1 and whole[0].body.splitlines() == BODIES + BODIES[:1]


def test_written_requests_hold_no_mappings_and_no_rejected_body(spark, work):
    def detector(texts, language):
        if any("b@c" in t for t in texts):
            raise RuntimeError("no")
        return [[] for _ in texts]

    df = spark.createDataFrame(list(enumerate(BODIES)), "body_id bigint, body string")
    done = sanitize_requests(df, Options(salt="s", on_error="closed"), detector=detector)
    for batch in (1, 2, 2):
        write_requests(done, f"{work}/out", "w", batch)
        write_rejected(done, f"{work}/bad", "w", batch)
    out, bad = spark.read.parquet(f"{work}/out"), spark.read.parquet(f"{work}/bad")
    assert sorted(r.body_id for r in out.collect()) == [0, 0, 1, 1]
    assert [r.body_id for r in bad.collect()] == [2, 2]
    assert set(out.columns) == {"body_id", "body", "status", "writer_id", "batch_id"}
    assert set(bad.columns) == {"body_id", "detect_error", "status", "writer_id", "batch_id"}
