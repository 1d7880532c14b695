"""Layout-like inputs derived from the given tables, as DataFrames and as the same SQL.

Documents become paragraphs (one for each line), pages of 3000 characters, batches of two pages. Roles follow from
positions, as the tables have no headings; batches keep page numbers of their own, with gaps and overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.ids import element_id
from leafmill.session import table

PAGE_CHARS = 3000
# Role by (7 * position + doc_id) mod 13.
ROLES = {0: "h1", 2: "h2", 4: "H3", 6: "sectionHeading", 8: "title", 9: "h4", 10: "pageHeader", 11: "h5", 12: "subtitle"}


def role_of(position: Column, doc: Column) -> Column:
    n = F.pmod(position * 7 + doc, F.lit(13))
    out = F.when(n == 0, ROLES[0])
    for k, r in list(ROLES.items())[1:]:
        out = out.when(n == k, r)
    return out


def paragraphs(spark: SparkSession, sf_dir: str, outer: bool = False) -> DataFrame:
    """doc_id, seq, content, span_offset, span_length, page_number, role, id. outer: null texts have a row without seq."""
    each = F.posexplode_outer if outer else F.posexplode
    lines = table(spark, sf_dir, "documents").select("doc_id", each(F.split("text", "\n")).alias("seq", "content"))
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = lines.withColumn("span_offset", F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0)).cast("long"))
    return at.select(
        "doc_id",
        F.col("seq").cast("long").alias("seq"),
        "content",
        "span_offset",
        F.length("content").cast("long").alias("span_length"),
        (F.floor(F.col("span_offset") / PAGE_CHARS) + 1).cast("long").alias("page_number"),
        role_of(F.col("seq").cast("long"), F.col("doc_id")).alias("role"),
    ).withColumn("id", element_id("para", F.col("page_number"), F.col("seq"), F.col("content")))


PARAGRAPHS = f"""
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS content, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS seq FROM documents
), placed AS (
  SELECT *, CAST(coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span_offset,
    CAST(length(content) AS BIGINT) AS span_length FROM lines
), paged AS (
  SELECT *, span_offset // {PAGE_CHARS} + 1 AS page_number,
    CASE (((seq * 7 + doc_id) % 13) + 13) % 13 {" ".join(f"WHEN {k} THEN '{r}'" for k, r in ROLES.items())} END AS role FROM placed
), para AS (
  SELECT *, 'para_' || page_number || '_' || seq || '_' || substr(md5('para_' || page_number || '_' || seq || '_' || substr(content, 1, 50)), 1, 6) AS id FROM paged
)
"""


def batches_of(paras: DataFrame) -> DataFrame:
    """Paragraphs with batch_no and the batch's own offsets and page numbers (span_offset, page_number)."""
    numbered = paras.withColumn("batch_no", F.floor((F.col("page_number") - 1) / 2).cast("long"))
    by = Window.partitionBy("doc_id", "batch_no")
    own = numbered.withColumn("own_start", F.min("span_offset").over(by)).withColumn("own_page", F.min("page_number").over(by))
    first = 1 + F.pmod(F.col("doc_id") + F.col("batch_no"), F.lit(3)) * 4
    return own.select("doc_id", "batch_no", "seq", "content", F.col("span_offset").alias("true_offset"), F.col("page_number").alias("true_page"), (F.col("span_offset") - F.col("own_start")).alias("span_offset"), (F.col("page_number") - F.col("own_page") + first).alias("page_number"), "span_length")


def batch_table(parts: DataFrame) -> DataFrame:
    """doc_id, batch_no, content_length, first_page, last_page."""
    return parts.groupBy("doc_id", "batch_no").agg(F.sum(F.col("span_length") + 1).alias("content_length"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count("*").alias("n"))


BATCHES = """
numbered AS (
  SELECT *, (page_number - 1) // 2 AS batch_no FROM para
), owned AS (
  SELECT *, min(span_offset) OVER (PARTITION BY doc_id, batch_no) AS own_start, min(page_number) OVER (PARTITION BY doc_id, batch_no) AS own_page FROM numbered
), parts AS (
  SELECT doc_id, batch_no, seq, content, span_offset AS true_offset, page_number AS true_page, span_offset - own_start AS span_offset, span_length,
    page_number - own_page + 1 + ((((doc_id + batch_no) % 3) + 3) % 3) * 4 AS page_number FROM owned
), batch AS (
  SELECT doc_id, batch_no, CAST(sum(span_length + 1) AS BIGINT) AS content_length, min(page_number) AS first_page, max(page_number) AS last_page, count(*) AS n FROM parts GROUP BY doc_id, batch_no
)
"""


def layout_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs as elements for filtering: some without id, page headers as a field, and their field names.

    doc_id, seq, id, content, role, element_type, page_number, page_header, keys.
    """
    p = paragraphs(spark, sf_dir)
    return p.select(
        "doc_id",
        "seq",
        F.when(F.pmod("seq", F.lit(5)) == 3, F.lit(None)).otherwise(F.col("id")).alias("id"),
        "content",
        "role",
        F.lit("paragraph").alias("element_type"),
        "page_number",
        F.when(F.pmod("seq", F.lit(4)) == 0, F.concat(F.lit("page "), F.col("page_number").cast("string"))).alias("page_header"),
        F.when(F.pmod("seq", F.lit(2)) == 0, F.array(*[F.lit(k) for k in ("_id", "content", "spans", "role")])).otherwise(F.array(*[F.lit(k) for k in ("content", "boundingRegions", "spans")])).alias("keys"),
    )


ELEMENTS = """
elements AS (
  SELECT doc_id, seq, CASE WHEN seq % 5 = 3 THEN NULL ELSE id END AS id, content, role, 'paragraph' AS element_type, page_number,
    CASE WHEN seq % 4 = 0 THEN 'page ' || page_number END AS page_header,
    CASE WHEN seq % 2 = 0 THEN ['_id', 'content', 'spans', 'role'] ELSE ['content', 'boundingRegions', 'spans'] END AS keys FROM para
)
"""
BLANK_SAFE = "regexp_matches(content, '[^\\s\\x1c-\\x1f]')"


def heads_sql(source: str, level: str) -> str:
    """CTE `headed`: source with lvl and h1 to h6, by windows."""
    last = ", ".join(f"last_value(CASE WHEN lvl <= {k} THEN struct_pack(l := lvl, c := content) END IGNORE NULLS) OVER w AS x{k}" for k in range(1, 7))
    heads = ", ".join(f"CASE WHEN x{k}.l = {k} THEN x{k}.c END AS h{k}" for k in range(1, 7))
    return f"""
levelled AS (SELECT *, {level} AS lvl FROM {source}),
ran AS (SELECT *, {last} FROM levelled WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
headed AS (SELECT * EXCLUDE (x1, x2, x3, x4, x5, x6), {heads} FROM ran)
"""


LITERAL_LEVEL = "CASE WHEN regexp_matches(lower(role), '^h[1-6]$') THEN CAST(substr(role, 2, 1) AS INTEGER) END"
HEADING_LEVEL = f"CASE lower(role) WHEN 'sectionheading' THEN 2 WHEN 'title' THEN 1 WHEN 'pageheader' THEN 1 WHEN 'subtitle' THEN 2 ELSE {LITERAL_LEVEL} END"
PARENT = "coalesce(" + ", ".join(f"nullif(h{k}, '')" for k in range(1, 7)) + ")"
