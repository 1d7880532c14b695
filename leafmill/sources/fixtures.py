"""Small layout documents for tests and trials, from rows, with spans, regions and identifiers as an extractor gives them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.ids import element_id


def layout_documents(paragraphs: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id and raw (layout JSON) from paragraphs (doc_id, seq, page_number, role, content).

    Offsets grow by a paragraph's length and one; each page lists its number, the document its content and paragraphs.
    """
    by = Window.partitionBy("doc_id").orderBy("seq")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    text = F.coalesce("content", F.lit(""))
    placed = paragraphs.withColumn("place", F.row_number().over(by) - 1).withColumn("offset", F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0)).cast("long"))
    region = F.array(F.struct(F.col("page_number").alias("pageNumber")))
    spans = F.array(F.struct("offset", F.length(text).alias("length")))
    own = [element_id("para", F.col("page_number"), F.col("place"), text).alias("_id")] if with_ids else []
    part = F.struct("seq", F.struct(*own, "content", "role", region.alias("boundingRegions"), spans.alias("spans")).alias("e"))
    gathered = placed.groupBy("doc_id").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.array_sort(F.collect_set(F.struct(F.col("page_number").alias("pageNumber")))).alias("pages"))
    content = F.array_join(F.transform("parts", lambda p: F.coalesce(p["e"]["content"], F.lit(""))), "\n")
    return gathered.select("doc_id", F.to_json(F.struct(content.alias("content"), "pages", F.transform("parts", lambda p: p["e"]).alias("paragraphs"))).alias("raw"))
