"""Shared storage and a skew-safe join back to groups."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_SHARE = 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session without that setting that runs in one process (tests) gets a
    folder made for it; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="veilmark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` once to the shared folder and read it back.

    Cuts lineage: what was written outlives the executors that made it.
    """
    path = new_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of(name: str, folder: str | None = None) -> str:
    """A public tokenizer's file; ``folder`` overrides where they are looked for."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def join_groups(
    rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column
) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (unique ``key``, its row count ``size``).

    A key with more than 1/1024 of all rows is dealt over several cells, by the
    ``spread`` column of the row, and its group row is copied to them.  At most 1024
    keys can be that large, so the broadcast list of them has at most 1024 entries.
    ``groups`` should be stored: it is read three times.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    cell_rows = max(total // HOT_SHARE, 1)
    cells = F.ceil(F.col(size) / F.lit(cell_rows)).cast("int")
    hot = groups.where((F.col(size) > cell_rows) & (F.lit(total) > HOT_SHARE)).select(
        F.col(key).alias("_hot"), cells.alias("_cells")
    )
    hot = F.broadcast(hot)

    def dealt(side: DataFrame) -> DataFrame:
        return side.join(hot, F.col(key) == F.col("_hot"), "left").withColumn(
            "_cells", F.coalesce("_cells", F.lit(1))
        )

    left = (
        dealt(rows)
        .withColumn("_cell", F.pmod(F.xxhash64(spread), "_cells"))
        .drop("_hot", "_cells")
    )
    right = (
        dealt(groups)
        .withColumn(
            "_cell", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))
        )
        .withColumn("_cell", F.col("_cell").cast("long"))
        .drop("_hot", "_cells")
    )
    return left.join(right, [key, "_cell"]).drop("_cell")
