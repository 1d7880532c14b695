"""Checks and comparisons of elements and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def span_faults(elements: DataFrame, content_length: str = "content_length", key: str = "doc_id") -> DataFrame:
    """Elements whose offset is below the one before, or whose end is beyond the content: key, seq, fault."""
    before = F.lag("span_offset").over(Window.partitionBy(key).orderBy("seq"))
    fault = F.when(F.col("span_offset") < before, "not monotonic").when(F.col("span_offset") + F.col("span_length") > F.col(content_length), "out of bounds")
    return elements.withColumn("fault", fault).where("fault is not null").select(key, "seq", "fault")


def page_subset(elements: DataFrame, low: int, high: int, key: str = "doc_id") -> DataFrame:
    """Elements with a region in the page range; elements has `regions`, an array of page numbers."""
    return elements.where(F.exists("regions", lambda p: (p >= low) & (p <= high)))


def batch_skew(batches: DataFrame, key: str = "doc_id") -> DataFrame:
    """By document: batches, the largest and mean number of elements, and if all have some and the largest is under three
    times the mean."""
    found = batches.groupBy(key).agg(F.count("*").alias("batches"), F.max("n").alias("largest"), F.avg("n").alias("mean"), F.min("n").alias("least"))
    return found.withColumn("balanced", (F.col("least") > 0) & (F.col("largest") < 3 * F.col("mean"))).drop("least")


def page_continuity(elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """By batch: pages, and if there is no page missing between its first and last."""
    found = elements.groupBy(key, "batch_no").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count_distinct("page_number").alias("pages"))
    return found.withColumn("continuous", F.col("last_page") - F.col("first_page") + 1 == F.col("pages"))


def differences(a: DataFrame, b: DataFrame, without: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows of either frame that the other lacks, columns such as identifiers left out: side and the rest."""
    columns = [c for c in a.columns if c not in without]
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).select(F.lit("left").alias("side"), *columns).union(y.exceptAll(x).select(F.lit("right").alias("side"), *columns))


def duplicates(ids: DataFrame, column: str = "id") -> DataFrame:
    """Values that stand more than once, and how often."""
    return ids.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")
