"""The choice of disjoint spans on a table with one row per finding.

For texts with more findings than an array should hold.  Findings that overlap, directly or
through others, form an island; between islands there is a gap, so each is chosen from alone.
Islands are found by running maxima that are cut into ranges of positions, and a document
with millions of findings is spread over as many tasks as it has ranges and islands.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE = 1 << 16


def islands(findings: DataFrame, keys: list[str], positions: int = RANGE) -> DataFrame:
    """Findings with ``_island``, a number that overlapping ones of a document share.

    Two running aggregates over a document, the largest end so far and the number of gaps
    so far, are each taken inside a range of ``positions`` first; what earlier ranges add
    is a running aggregate over one small row a range.
    """
    placed = findings.withColumn("_range", F.expr(f"start div {positions}"))
    here = Window.partitionBy(*keys, "_range").orderBy("start", F.desc("end"))
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)

    def joined(rows: DataFrame, sums: DataFrame) -> DataFrame:
        same = F.col("_range") == F.col("_other__range")
        for key in keys:
            same &= F.col(key).eqNullSafe(F.col(f"_other_{key}"))
        renamed = sums.withColumnsRenamed({c: f"_other_{c}" for c in [*keys, "_range"]})
        return rows.join(renamed, same).drop(*[f"_other_{c}" for c in [*keys, "_range"]])

    reach = placed.groupBy(*keys, "_range").agg(F.max("end").alias("_end"))
    reach = reach.withColumn("_reach", F.max("_end").over(ranges)).drop("_end")
    marked = joined(placed.withColumn("_seen", F.max("end").over(before)), reach)
    # both are null only for a document's first finding
    far = F.greatest("_seen", "_reach")
    marked = marked.withColumn("_gap", (far.isNull() | (F.col("start") >= far)).cast("long"))
    gaps = marked.groupBy(*keys, "_range").agg(F.sum("_gap").alias("_gaps"))
    gaps = gaps.withColumn("_base", F.coalesce(F.sum("_gaps").over(ranges), F.lit(0))).drop("_gaps")
    # of findings with equal places the one that begins the island comes first
    up_to = Window.partitionBy(*keys, "_range").orderBy("start", F.desc("end"), F.desc("_gap"))
    up_to = up_to.rowsBetween(Window.unboundedPreceding, 0)
    counted = joined(marked.withColumn("_count", F.sum("_gap").over(up_to)), gaps)
    return counted.withColumn("_island", F.col("_base") + F.col("_count")).drop(
        "_range", "_seen", "_reach", "_gap", "_count", "_base"
    )


def select_spans_long(
    findings: DataFrame,
    keys: str | list[str],
    order: str | None = None,
    length: str | None = None,
    positions: int = RANGE,
) -> DataFrame:
    """The rows that ``select_spans`` would keep, of a table (keys, start, end, score, ...).

    Of each document's valid findings the earliest, then longest, then best scored, then the
    one with the smallest ``order`` column is taken if it does not overlap one taken before; a
    null score is the lowest.  ``length`` names the column with the text's length, where findings
    may end beyond it.  Findings with a null or negative start, or an end that is not behind it,
    are left out.  Rows that agree in all of that are told apart by nothing: one is taken.  Keys
    may be null.  An island is walked in order by one task with a fixed memory.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    valid = F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")), F.lit(False))
    if length is not None:
        valid &= F.coalesce(F.col("end") <= F.col(length), F.lit(False))
    placed = islands(findings.where(valid), keys, positions)
    last = [F.col(order)] if order is not None else []
    sort = [*keys, "_island", "start", F.desc("end"), F.desc_nulls_last("score"), *last]
    dealt = placed.repartition(*keys, "_island").sortWithinPartitions(*sort)
    names = placed.columns
    at = {c: names.index(c) for c in ("start", "end")}
    whole = [names.index(c) for c in [*keys, "_island"]]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        island, reach = None, 0
        for batch in batches:
            places = zip(*(batch.column(k).to_pylist() for k in whole), strict=True)
            starts = batch.column(at["start"]).to_pylist()
            ends = batch.column(at["end"]).to_pylist()
            kept = []
            for name, start, end in zip(places, starts, ends, strict=True):
                if name != island:
                    island, reach = name, 0
                kept.append(start >= reach)
                if kept[-1]:
                    reach = end
            yield batch.filter(pa.array(kept, pa.bool_()))

    return dealt.mapInArrow(walk, dealt.schema).drop("_island")
