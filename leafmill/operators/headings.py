"""Heading levels and the headings that stand above each element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = range(1, 7)


def literal_level(role: Column) -> Column:
    """1 to 6 for h1 to h6 in any case, else null."""
    return F.when(F.lower(role).rlike("^h[1-6]$"), F.substring(role, 2, 1).cast("int"))


def heading_level(role: Column) -> Column:
    """As literal_level, and for the layout roles of headings."""
    low = F.lower(role)
    return F.when(low == "sectionheading", 2).when(low.isin("title", "pageheader"), 1).when(low == "subtitle", 2).otherwise(literal_level(role))


def with_context(elements: DataFrame, level: Column, order: str = "seq", key: str = "doc_id") -> DataFrame:
    """elements with h1 to h6: the headings in force at each row, its own included.

    The last heading of level k or above decides h_k: its text if its level is k, else nothing. One window, no loop.
    """
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = elements.withColumn("__level", level)
    last = [F.last(F.when(F.col("__level") <= k, F.struct("__level", "content")), ignorenulls=True).over(upto).alias(f"__h{k}") for k in LEVELS]
    found = marked.select("*", *last)
    heads = [F.when(F.col(f"__h{k}.__level") == k, F.col(f"__h{k}.content")).alias(f"h{k}") for k in LEVELS]
    return found.select(*elements.columns, *heads)


def parent_section() -> Column:
    """The shallowest heading in force that isn't empty, of columns h1 to h6."""
    return F.coalesce(*[F.nullif(F.col(f"h{k}"), F.lit("")) for k in LEVELS])
