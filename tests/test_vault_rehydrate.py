import pytest
from pyspark.sql import functions as F

from veilmark.functions.tokens import make_token
from veilmark.operators.lookup import key_counts, lookup
from veilmark.operators.redact import extract_mappings, redact
from veilmark.operators.rehydrate import rehydrate
from veilmark.operators.vault import (
    VAULT_SCHEMA,
    detokenize,
    vault_get,
    vault_live,
    vault_purge,
    vault_put,
)
from veilmark.options import Options
from veilmark.plans.jobs import round_trip
from veilmark.sources.tables import compact_vault, read_vault, write_vault

REGEX = Options(salt="salt", backend="regex")
T0, T1, T2 = "2026-01-01 00:00:00", "2026-01-01 01:00:00", "2026-01-01 02:00:00"


def entries(spark, rows):
    df = spark.createDataFrame(rows, "token string, value string, w string, e string")
    return df.select("token", "value", F.lit("P").alias("entity_type"),
                     F.col("w").cast("timestamp").alias("written_at"),
                     F.col("e").cast("timestamp").alias("expires_at"))


def test_expiry_edge(spark):
    mappings = spark.createDataFrame([("t", "v", "P")], "token string, value string, entity_type string")
    vault = vault_put(mappings, 3600, T0)
    assert vault_live(vault, T1).count() == 1
    assert vault_live(vault, "2026-01-01 01:00:00.000001").count() == 0


def test_last_write_wins_and_refreshes(spark):
    vault = entries(spark, [("t", "old", T0, T1), ("t", "new", "2026-01-01 00:30:00", T2),
                            ("s", "long", T0, T2), ("s", "short", "2026-01-01 00:30:00", T1)])
    rows = {r.token: r.value for r in vault_live(vault, "2026-01-01 01:30:00").collect()}
    # the newest write of "s" has expired; the older one does not come back
    assert rows == {"t": "new"}
    assert vault_purge(vault, T0).count() == 2


def test_ttl_must_be_positive(spark):
    with pytest.raises(ValueError):
        vault_put(entries(spark, []), 0)


def test_get_and_detokenize(spark):
    vault = entries(spark, [("a", "A", T0, T2), ("b", "B", T0, T0)])
    df = spark.createDataFrame([("a",), ("b",), ("zz",), (None,)], "token string")
    got = {r.token: r.value for r in vault_get(df, vault, now=T1).collect()}
    assert got == {"a": "A", "b": None, "zz": None, None: None}
    back = sorted(str(r.token) for r in detokenize(df, vault, "token", T1).collect())
    assert back == ["A", "None", "b", "zz"]


def test_lookup_splits_hot_keys_without_changing_the_result(spark):
    left = spark.range(0, 4000, 1, 8).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
        .otherwise((F.col("id") % 700).cast("string")).alias("k"))
    table = spark.range(500).select(F.col("id").cast("string").alias("tk"), (F.col("id") * 2).alias("v")).union(
        spark.createDataFrame([("hot", -1)], "tk string, v bigint"))
    want = sorted(map(str, left.join(table, left.k == table.tk, "left").drop("tk").collect()))
    for hot_rows in (10, 500, 10**6):
        assert sorted(map(str, lookup(left, "k", table, "tk", key_counts(left, "k"), hot_rows).collect())) == want


def test_vault_table_replaces_a_replayed_batch(spark, work):
    path = f"{work}/vault"
    vault = entries(spark, [("a", "A", T0, T2), ("b", "B", T0, T1)])
    for writer, batch in (("a", 0), ("a", 1), ("a", 1), ("b", 1)):
        write_vault(vault, path, writer, batch)
    assert read_vault(spark, path).count() == 6
    with pytest.raises(ValueError):
        write_vault(vault, path, "", 0)
    assert vault_live(read_vault(spark, path), T0).count() == 2
    compact_vault(spark, path, f"{work}/vault2", "2026-01-01 01:30:00")
    write_vault(vault.where("false"), f"{work}/vault2", "a", 0)
    assert [r.token for r in read_vault(spark, f"{work}/vault2").collect()] == ["a"]


def test_vault_reads_only_days_that_can_be_live(spark, work):
    path = f"{work}/vault"
    days = [f"2026-01-{d:02d} 12:00:00" for d in range(1, 21)]
    write_vault(entries(spark, [(d, d, d, d.replace("12:", "23:")) for d in days]), path, "a", 0)
    now = "2026-01-20 13:00:00"
    pruned = read_vault(spark, path, longest_ttl_seconds=12 * 3600, now=now)
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(written_day" in plan
    assert {r.token for r in pruned.collect()} <= set(days[-3:])
    live = {r.token for r in vault_live(pruned, now).collect()}
    assert live == {r.token for r in vault_live(read_vault(spark, path), now).collect()} == {days[-1]}


def test_rows_of_one_key_or_none_are_not_mixed(spark):
    tok = lambda v: spark.range(1).select(F.expr(make_token("'P'", f"'{v}'", "s"))).first()[0]
    vault = entries(spark, [(tok("x"), "X", T0, T2), (tok("y"), "Y", T0, T2)])
    rows = [(1, f"mail {tok('x')}"), (1, f"mail {tok('y')} {tok('x')}"), (None, tok("y")),
            (None, tok("y")), (1, "none"), (2, None)]
    df = spark.createDataFrame(rows, "key int, text string")
    got = sorted(map(tuple, rehydrate(df, vault, "key", now=T1).collect()), key=str)
    assert got == sorted([(1, "mail X"), (1, "mail Y X"), (None, "Y"), (None, "Y"), (1, "none"),
                          (2, None)], key=str)


def test_documents_round_trip(spark, documents):
    trip = round_trip(documents, REGEX, "doc_id")
    assert trip.count() == documents.count()
    assert trip.where("NOT original <=> restored").count() == 0


def test_restored_text_is_not_scanned_again(spark):
    tok = lambda v: spark.range(1).select(F.expr(make_token("'P'", f"'{v}'", "s"))).first()[0]
    inner, outer = tok("x"), tok("y")
    vault = entries(spark, [(inner, "X", T0, T2), (outer, f"<{inner}> [", T0, T2)])
    texts = [f"{outer}[CMPL_", f"{outer}{inner}{outer}", "x [[CMPL_P_0000000000000000]] y",
             "matrix [[a]] and [[3;4]] stay", "", None, "[[CMPL_" + inner]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.text for r in rehydrate(df, vault, "id", now=T1).collect()}
    assert got == {0: f"<{inner}> [[CMPL_", 1: f"<{inner}> [X<{inner}> [", 2: texts[2],
                   3: texts[3], 4: "", 5: None, 6: "[[CMPL_X"}


def test_empty_vault_keeps_everything(spark, documents):
    redacted = redact(documents, REGEX).select("doc_id", "text")
    back = rehydrate(redacted, spark.createDataFrame([], VAULT_SCHEMA), "doc_id")
    assert back.exceptAll(redacted).count() == 0 and back.count() == redacted.count()


def test_hot_token_restores_the_same(spark, documents):
    with_copies = documents.crossJoin(spark.range(3)).select(
        (F.col("doc_id") * 3 + F.col("id")).alias("doc_id"),
        F.concat("text", F.lit(" hot@hot.com")).alias("text"))
    redacted = redact(with_copies, REGEX)
    vault = vault_put(extract_mappings(redacted), 3600, T0)
    args = (redacted.select("doc_id", "text"), vault, "doc_id", "text", T1)
    for hot_rows in (5, 10**6):
        assert rehydrate(*args, hot_rows=hot_rows).exceptAll(with_copies).count() == 0
