"""Identifiers of the parts of layout documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.ids import PREFIX, cell_id, element_id, pair_content


def assign_ids(documents: DataFrame, key: str = "source_file") -> DataFrame:
    """doc_id, kind, arr_idx, id of all parts of parsed documents (column doc, see sources.layout), cells included.

    An index counts a kind's parts over the whole document. Pages are the first region's, or 1; pairs stand on page 1.
    """
    base = documents.select(F.col(key).alias("doc_id"), "doc")

    def of(kind: str) -> DataFrame:
        return base.select("doc_id", F.posexplode(f"doc.{kind}").alias("arr_idx", "e"))

    page = F.coalesce(F.try_element_at("e.boundingRegions", F.lit(1))["pageNumber"], F.lit(1))
    at, out = F.col("arr_idx"), None
    content = {"paragraphs": F.col("e.content"), "formulas": F.col("e.value")}
    for kind in ("paragraphs", "tables", "lists", "figures", "formulas"):
        rows = of(kind).select("doc_id", F.lit(kind).alias("kind"), at.cast("string").alias("place"), element_id(PREFIX[kind], page, at, content.get(kind) if kind in content else None).alias("id"))
        out = rows if out is None else out.unionByName(rows)
    pairs = of("keyValuePairs").select("doc_id", F.lit("keyValuePairs").alias("kind"), at.cast("string").alias("place"), element_id("kv", F.lit(1), at, pair_content(F.col("e.key.content"), F.col("e.value.content"))).alias("id"))
    cells = of("tables").select("doc_id", page.alias("page"), at.alias("t"), F.posexplode("e.cells").alias("c", "cell"))
    own = cells.select("doc_id", F.lit("cells").alias("kind"), F.concat_ws("/", F.col("t").cast("string"), F.col("c").cast("string")).alias("place"), cell_id(F.col("page"), F.col("t"), F.col("cell.rowIndex"), F.col("cell.columnIndex"), F.col("cell.content")).alias("id"))
    return out.unionByName(pairs).unionByName(own)
