"""Dictionary detection with the terms in a table, for lists of any length.

A task hashes every window of a text that is as long as some term, by differences of one
running hash, and looks it up in a bitmap of all terms' hashes.  The windows that pass, a
few more than are terms, go to an equi-join with the terms on the whole window.  The
text itself does not travel for that, and terms may share any beginning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions.exprs import FINDINGS, empty
from veilmark.functions.fixed import DICTIONARY_SCORE
from veilmark.functions.windows import bitmap_bits, candidates_of, term_slot, text_runs

_WINDOWS = "array<struct<at:int,term:string>>"


def _term_slot(bits: int):
    @F.pandas_udf("bigint")
    def run(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: term_slot(t, bits))

    return run


def _windows(bitmap: np.ndarray, sizes: list[int], bits: int):
    """Text -> the windows that may be terms."""

    @F.arrow_udf(_WINDOWS)
    def run(texts: pa.Array) -> pa.Array:
        ats, terms, ends = [], [], [0]
        for start, stop in text_runs(pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)):
            for found in candidates_of(texts.slice(start, stop - start).to_pylist(), bitmap, sizes, bits):
                ats += [at for at, _ in found]
                terms += [term for _, term in found]
                ends.append(len(ats))
        # a null text has no windows, and no row of its own is made of it
        rows = pa.StructArray.from_arrays([pa.array(ats, pa.int32()), pa.array(terms, pa.string())], ["at", "term"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return run


def detect_terms(df: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Every occurrence, overlapping ones too, of the terms of a table.

    ``terms`` has ``term`` and ``entity_type``; null and empty terms are left out, of
    repeated terms the smallest entity type counts.  Adds ``findings`` (by start, then
    end; null for a null text) and ``detect_error``, as ``detect_dictionary`` does.

    The driver sees the terms' lengths and a bitmap of 16 bits a term, at most 16 MB, put
    together in Spark; with more than 8 million terms it lets more windows through, and the
    join decides all the same.  Rows are told apart by the digest of their text, so what is
    found in copies is joined once.
    """
    terms = (
        terms.where("term <> ''").groupBy("term").agg(F.min("entity_type").alias("entity_type"))
    )
    per_size = terms.groupBy(F.char_length("term").alias("size")).count().collect()
    sizes = sorted(r[0] for r in per_size)
    total = sum(r[1] for r in per_size)
    bits = bitmap_bits(total)
    slot = terms.select(_term_slot(bits)("term").alias("slot"))
    words = slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")
    )
    bitmap = np.zeros(1 << bits - 6, np.uint64)
    for word, value in words.collect():
        bitmap[word] = value & (1 << 64) - 1

    keyed = df.withColumn("_digest", F.sha2(F.col(text).cast("binary"), 256))
    windows = keyed.select(
        "_digest", F.explode(_windows(bitmap, sizes, bits)(F.col(text))).alias("_window")
    ).select("_digest", F.col("_window.at").alias("_at"), F.col("_window.term").alias("term"))
    found = (
        windows.distinct()
        .join(terms, "term")
        .groupBy("_digest")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col("_at").alias("start"),
                        (F.col("_at") + F.char_length("term")).alias("end"),
                        "entity_type",
                    )
                )
            ).alias("_found")
        )
    )
    as_findings = (
        "transform(_found, f -> named_struct('entity_type', f.entity_type, 'start', f.start, "
        f"'end', f.end, 'score', cast({DICTIONARY_SCORE!r} as double)))"
    )
    findings = F.when(
        F.col(text).isNotNull(),
        F.coalesce(F.expr(as_findings).cast(FINDINGS), F.expr(empty(FINDINGS))),
    )
    return (
        keyed.join(found, "_digest", "left")
        .withColumns({"findings": findings, "detect_error": F.lit(None).cast("string")})
        .drop("_digest", "_found")
    )
