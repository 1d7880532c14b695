"""Stitching of page batches into whole documents, as prefix sums over batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_ranges(documents: DataFrame, pages: str, batch_size: int, key: str = "doc_id") -> DataFrame:
    """The page ranges of each document: key, first_page, last_page."""
    if batch_size < 1:
        raise ValueError("batch_size is positive")
    some = documents.where(F.col(pages) >= 1)
    first = some.select(key, pages, F.explode(F.sequence(F.lit(1).cast("long"), F.col(pages).cast("long"), F.lit(batch_size).cast("long"))).alias("first_page"))
    return first.select(key, "first_page", F.least(F.col("first_page") + batch_size - 1, F.col(pages).cast("long")).alias("last_page"))


def batch_offsets(batches: DataFrame, key: str = "doc_id") -> DataFrame:
    """What each batch's offsets and page numbers are raised by: key, batch_no, content_offset, page_offset.

    batches: key, batch_no, content_length, first_page, last_page (both of the batch's own numbering). Pages follow the
    highest page before; the first batch keeps its numbers. A column `given_offset`, where it is not null, is taken as the
    batch's page offset instead, the first batch's too.
    """
    order = Window.partitionBy(key).orderBy("batch_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    raised = F.coalesce(F.sum("content_length").over(before), F.lit(0)).cast("long").alias("content_offset")
    spread = F.col("last_page") - F.col("first_page") + 1
    if "given_offset" not in batches.columns:
        top = F.first("first_page").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1 + F.sum(spread).over(before)
        return batches.select(key, "batch_no", raised, F.coalesce(top + 1 - F.col("first_page"), F.lit(0)).cast("long").alias("page_offset"))
    # Pages since the last batch whose last page is known (a given offset, or the first batch) are a sum of spreads again.
    known = F.when(F.col("given_offset").isNotNull(), F.col("given_offset")).when(F.row_number().over(order) == 1, F.lit(0))
    marked = batches.select(key, "batch_no", "first_page", spread.alias("spread"), raised, known.alias("known"), (F.col("last_page") + known).alias("ends"))
    run = marked.withColumn("run", F.count("known").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = Window.partitionBy(key, "run").orderBy("batch_no")
    since = F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("spread"))).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = F.first("ends").over(inside) + since
    return run.select(key, "batch_no", "content_offset", F.coalesce("known", top + 1 - F.col("first_page")).cast("long").alias("page_offset"))


def stitch(elements: DataFrame, batches: DataFrame, key: str = "doc_id") -> DataFrame:
    """elements with span_offset, page_number and the pages of `regions` (if there) raised by their batch's offsets.

    Where elements have a `kind` and batches a `given_offset`, that of a document's first batch moves pages, paragraphs and
    tables only, and leaves words, lines and selection marks at their own pages.
    """
    raised = elements.join(batch_offsets(batches, key), [key, "batch_no"])
    if "kind" in elements.columns and "given_offset" in batches.columns:
        first = batches.groupBy(key).agg(F.min("batch_no").alias("__first"))
        stays = (F.col("batch_no") == F.col("__first")) & F.col("kind").isin("words", "lines", "selectionMarks")
        raised = raised.join(first, key).withColumn("page_offset", F.when(stays, 0).otherwise(F.col("page_offset"))).drop("__first")
    if "regions" in elements.columns:
        raised = raised.withColumn("regions", raise_regions(F.col("regions"), F.col("page_offset")))
    return raised.withColumn("span_offset", F.col("span_offset") + F.col("content_offset")).withColumn("page_number", F.col("page_number") + F.col("page_offset")).drop("content_offset", "page_offset")


def raise_regions(regions: Column, by: Column) -> Column:
    """An array of bounding regions with each pageNumber raised."""
    return F.transform(regions, lambda r: r.withField("pageNumber", (r["pageNumber"] + by).cast("int")))


def stitched_content(batches: DataFrame, key: str = "doc_id") -> DataFrame:
    """The batches' contents joined without a separator."""
    ordered = F.sort_array(F.collect_list(F.struct("batch_no", "content")))
    return batches.groupBy(key).agg(F.array_join(F.transform(ordered, lambda b: b["content"]), "").alias("content"))


def violations(batches: DataFrame) -> DataFrame:
    """A row for each fault of a batch: its columns and `fault`. batches has content (string) and pages (array of ints)."""
    bad = F.filter(F.col("pages"), lambda p: p.isNull() | (p <= 0))
    faults = F.array(
        F.when(F.col("content").isNull(), F.lit("missing content")),
        F.when(F.col("pages").isNull(), F.lit("missing pages")),
        F.when(F.size(bad) > 0, F.lit("page number not positive")),
    )
    return batches.withColumn("fault", F.explode(F.filter(faults, lambda f: f.isNotNull())))


def json_faults(batches: DataFrame) -> DataFrame:
    """A row for each fault of a batch as JSON (`raw`): its columns and `fault`, by the types of what is there."""
    whole = F.try_parse_json("raw")
    kind = lambda v, path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    top, content, pages = kind(whole, "$"), kind(whole, "$.content"), kind(whole, "$.pages")
    each = F.try_variant_get(whole, "$.pages", "array<variant>")

    def of_page(v: Column, i: Column) -> Column:
        number = kind(v, "$.pageNumber")
        named = lambda text: F.concat(F.lit("page "), i.cast("string"), F.lit(text))
        positive = (number == "BIGINT") & (F.try_variant_get(v, "$.pageNumber", "long") > 0)
        return (
            F.when(~kind(v, "$").startswith("OBJECT"), named(" is not an object"))
            .when(number.isNull(), named(" has no pageNumber"))
            .when(~positive, named(" has a pageNumber that is not a positive integer"))
        )

    ok = top.startswith("OBJECT")
    faults = F.array(
        F.when(~F.coalesce(ok, F.lit(False)), F.lit("not an object")),
        F.when(ok & content.isNull(), F.lit("content is missing")),
        F.when(ok & (content != "STRING"), F.lit("content is not a string")),
        F.when(ok & pages.isNull(), F.lit("pages are missing")),
        F.when(ok & ~pages.startswith("ARRAY"), F.lit("pages are not a list")),
    )
    inside = F.coalesce(F.transform(F.when(ok, each), of_page), F.array().cast("array<string>"))
    return batches.withColumn("fault", F.explode(F.filter(F.concat(faults, inside), lambda f: f.isNotNull())))


def require_valid(batches: DataFrame, shown: int = 5) -> DataFrame:
    """batches, if json_faults has none; else raises ValueError with the first few."""
    found = [r["fault"] for r in json_faults(batches).select("fault").limit(shown).collect()]
    if found:
        raise ValueError("; ".join(found))
    return batches


def gaps(batches: DataFrame, key: str = "doc_id") -> DataFrame:
    """Batches that do not begin right after the one before: key, batch_no, expected_page, first_page."""
    order = Window.partitionBy(key).orderBy("batch_no")
    some = batches.where(F.col("first_page").isNotNull())
    return some.withColumn("expected_page", F.lag("last_page").over(order) + 1).where("first_page <> expected_page").select(key, "batch_no", "expected_page", "first_page")
