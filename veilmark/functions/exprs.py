"""Helpers shared by the expression modules.

Expression builders here work on SQL text: an argument is a column name or any
SQL expression, and the result is SQL text too (``F.expr`` makes it a column).
Large expressions are built once as text and parsed once, which costs the driver
milliseconds instead of thousands of calls into the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.fixed import WHITE_SPACE

FINDING = "struct<entity_type:string,`start`:int,`end`:int,score:double>"
FINDINGS = f"array<{FINDING}>"
MAPPING = "struct<token:string,value:string,entity_type:string>"
MAPPINGS = f"array<{MAPPING}>"
REDACTED = f"struct<text:string,mappings:{MAPPINGS}>"


def text_literal(text: str) -> str:
    """SQL literal that no parser setting reads differently."""
    if text.isprintable() and not set(text) & set("'$"):
        return f"r'{text}'"
    return f"cast(X'{text.encode().hex()}' as string)"


def bind(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``.

    A lambda variable holds the value, so Catalyst cannot copy an expensive
    expression (a regex, an array build) into every place that refers to it.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def empty(array_type: str) -> str:
    return f"cast(array() as {array_type})"


def struct(**fields: str) -> str:
    return (
        "named_struct("
        + ", ".join(f"'{name}', {value}" for name, value in fields.items())
        + ")"
    )


def is_blank(text: str) -> str:
    return f"rlike({text}, {text_literal(f'^[{WHITE_SPACE}]*$')})"


def inline_rows(df: DataFrame, keys: Sequence[str], array: str | Column) -> DataFrame:
    """Key columns and one row per struct of ``array``; empty arrays give none.

    Written with the outer form: for the plain one Spark adds a filter on the
    array's size and pushes it down, which computes an expensive array twice.
    """
    exploded = df.select(*keys, F.explode_outer(array).alias("_item"))
    return exploded.where(F.col("_item").isNotNull()).select(*keys, "_item.*")


def where_once(df: DataFrame, condition: str) -> DataFrame:
    """``df.where(condition)`` for a condition on an expensively computed column.

    Spark would push the filter below the computation and so repeat it inside
    the filter.  A filter that also tests the partition number stays in place.
    """
    pinned = df.withColumn("_pin", F.spark_partition_id())
    return pinned.where(f"({condition}) AND _pin >= 0").drop("_pin")
