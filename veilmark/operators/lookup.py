"""Key lookup that holds when one key makes up a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
NULL_CELLS = 4096


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """(key, count): which keys a lookup needs, and which of them are hot.

    Repeats are counted inside each task before the shuffle.
    """
    return df.where(F.col(key).isNotNull()).groupBy(key).count()


def lookup(
    df: DataFrame,
    key: str,
    table: DataFrame,
    table_key: str,
    counts: DataFrame,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join of ``df`` with ``table``, which has unique ``table_key``.

    A key that occurs in more than ``hot_rows`` rows of ``df`` (by ``counts``) is
    spread over several join cells, each with its own copy of the table row.
    The list of hot keys is one hash and one small number per key, and at most
    ``rows / hot_rows`` keys can be hot, so joining it by broadcast is bounded.
    Rows whose key is null are spread over many cells too.
    Which keys are hot only decides where rows go, never what the result is.
    A row's cell follows from the number of its partition, so a task that is run
    again after an executor loss sends its rows to the same cells.
    """
    hot = counts.where(F.col("count") > hot_rows).select(
        F.xxhash64(key).alias("_hot"),
        F.ceil(F.col("count") / hot_rows).cast("int").alias("_cells"),
    )
    # one entry per hash, also if two hot keys should share it
    hot = hot.groupBy("_hot").agg(F.max("_cells").alias("_cells"))
    cells = F.coalesce("_cells", F.lit(1))
    # rows without a key match nothing; their cells only keep them apart
    dealt = F.when(F.col(key).isNull(), F.lit(NULL_CELLS)).otherwise(cells)
    left = (
        df.join(F.broadcast(hot), F.xxhash64(key) == F.col("_hot"), "left")
        .withColumn(
            "_cell", F.pmod(F.xxhash64(F.spark_partition_id()), dealt).cast("int")
        )
        .drop("_hot", "_cells")
    )
    right = (
        table.join(F.broadcast(hot), F.xxhash64(table_key) == F.col("_hot"), "left")
        .withColumn("_cell2", F.explode(F.sequence(F.lit(0), cells - 1)))
        .drop("_hot", "_cells")
    )
    return left.join(
        right,
        (F.col(key) == F.col(table_key)) & (F.col("_cell") == F.col("_cell2")),
        "left",
    ).drop("_cell", "_cell2", table_key)
