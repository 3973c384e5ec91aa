"""Connected components of a table of links, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import stored


def _hang(directed: DataFrame, keep: str) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them (the node included)."""
    least = directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        directed.join(least, "u")
        .where(keep)
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
    )


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): each linked node and the smallest node it can reach.

    Alternates two steps until nothing changes: every node hangs its larger
    neighbours on its smallest one, then every node hangs itself and its smaller
    neighbours on the smallest one.  Both keep connectivity, and the links end as
    stars around the smallest nodes, after a number of rounds that grows with the
    logarithm of the largest component.  Each round is written to the shared folder;
    only a count and a checksum come to the driver.  Hubs of many links are split by
    the skew-join rule, their minima are combined in each task first.  Links with a
    null end or of a node with itself are left out.
    """
    edges = links.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
    edges = stored(edges.distinct(), "links")
    before = None
    while True:
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both, "v > u").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.greatest("v", "m").alias("u"), F.col("m").alias("v")
        )
        small = small.where("u <> v").unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        edges = stored(small.distinct(), "links")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots
    )
