"""Queries over filtering: presets, mappings, metrics."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.model import DESCRIPTIONS, PRESETS, FilterConfig
from leafmill.operators import filtering
from leafmill.plans.inputs import BLANK_SAFE, ELEMENTS, LITERAL_LEVEL, PARAGRAPHS, PARENT, heads_sql, layout_elements, paragraphs

CUSTOM = FilterConfig("custom", ("pageNumber", "parentSection", "elementIndex"), include_element_ids=False)
# What each field is in SQL.
SQL_FIELDS = {
    "_id": "id", "content": "content", "pageNumber": "page_number", "role": "role", "elementType": "element_type", "elementIndex": "seq AS element_index",
    "parentSection": f"{PARENT} AS parent_section", "pageHeader": "page_header", "pageFooter": "CAST(NULL AS VARCHAR) AS page_footer", "documentMetadata": "CAST(NULL AS VARCHAR) AS document_metadata",
}
KEPT = f"WITH {PARAGRAPHS}, {ELEMENTS}, {heads_sql('elements', LITERAL_LEVEL)}, kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS filtered_index FROM headed WHERE {BLANK_SAFE} AND id IS NOT NULL)"


def _filter(config: FilterConfig, spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.filter_elements(layout_elements(spark, sf_dir), config)


def _sql(fields: tuple[str, ...]) -> str:
    if "*" in fields:
        return f"{KEPT} SELECT doc_id, filtered_index, id, content, role, element_type, page_number, page_header FROM kept"
    own = [SQL_FIELDS[f] for f in fields]
    if "content" not in fields:
        own.append("regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content")
    return f"{KEPT} SELECT doc_id, filtered_index, {', '.join(own)} FROM kept"


def element_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.element_mappings(layout_elements(spark, sf_dir))


def filter_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.counts(layout_elements(spark, sf_dir))


def filter_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of JSON as Python's json.dumps writes it, and of compact JSON."""
    return filtering.sizes(layout_elements(spark, sf_dir))


def raw_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs as raw JSON elements in four shapes: doc_id, seq, raw, parent_section."""
    p = paragraphs(spark, sf_dir)
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    shape = F.pmod("seq", F.lit(4))
    own = (
        F.when(shape == 0, F.array(entry("_id", F.col("id")), entry("id", F.lit("other")), entry("pageNumber", F.col("page_number")), entry("page_number", F.lit(0)), entry("odd", F.lit("x"))))
        .when(shape == 1, F.array(entry("id", F.col("id")), entry("page_number", F.col("page_number")), entry("type", F.lit("note"))))
        .when(shape == 2, F.array(entry("_id", F.lit(None)), entry("id", F.col("id")), entry("odd", F.lit("y"))))
        .otherwise(F.array(entry("_id", F.col("id")), entry("role", F.lit("text")), entry("type", F.lit("note")), entry("pageNumber", F.lit(None)), entry("page_number", F.lit(9))))
    )
    raw = F.to_json(F.map_from_entries(F.concat(own, F.array(entry("content", F.col("content"))))))
    return p.select("doc_id", "seq", raw.alias("raw"), F.when(F.pmod("seq", F.lit(3)) != 0, F.concat(F.lit("part "), F.col("doc_id").cast("string"))).alias("parent_section"))


def _raw(config: FilterConfig, spark: SparkSession, sf_dir: str) -> DataFrame:
    done = filtering.filter_raw(raw_elements(spark, sf_dir), config)
    lines = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("(null)")))))
    return done.select("doc_id", "filtered_index", "element_id", F.array_join(lines, "\n").alias("fields"))


def excluded_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.excluded_fields(layout_elements(spark, sf_dir), FilterConfig("citation_optimized"))


def _size_sql(fields: list[str], ascii_only: bool) -> str:
    n = lambda c, e: f"len(regexp_extract_all({c}, '{e}'))"
    gap = 2 if ascii_only else 1

    def text(c: str) -> str:
        own = f"length({c}) + 5 * {n(c, '[^\\x00-\\x7e]')} + 6 * {n(c, '[\\x{10000}-\\x{10ffff}]')}" if ascii_only else f"strlen({c})"
        return own + " + " + n(c, '["\\\\\\x08\\f\\n\\r\\t]') + " + 5 * " + n(c, "[\\x00-\\x07\\x0b\\x0e-\\x1f]") + " + 2"

    each = [f"coalesce({text(c) if c != 'page_number' else 'length(CAST(page_number AS VARCHAR))'} + {len(c) + 2 + 2 * gap}, 0)" for c in fields]
    return f"2 + greatest({' + '.join(each)} - {gap}, 0)"


PLAIN = ["id", "content", "role", "element_type", "page_number"]
SIZES = f"""WITH {PARAGRAPHS}, {ELEMENTS}, n AS (SELECT doc_id, CAST(sum({_size_sql(PLAIN, False)} + 1) AS BIGINT) AS original_bytes,
  CAST(coalesce(sum({_size_sql(["id", "content", "page_number"], False)} + 1) FILTER ({BLANK_SAFE} AND id IS NOT NULL), 0) AS BIGINT) AS filtered_bytes, CAST(sum({_size_sql(PLAIN, True)} + 2) AS BIGINT) AS json_bytes FROM elements GROUP BY doc_id)
SELECT *, (original_bytes - filtered_bytes) * 100.0::DOUBLE / original_bytes AS reduction_percent FROM n"""
_LINES = f"""WITH {PARAGRAPHS}, raws AS (SELECT doc_id, seq, id AS element_id, content, page_number, seq % 4 AS shape, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS filtered_index FROM para WHERE {BLANK_SAFE} AND seq % 4 <> 2),
entries AS (SELECT doc_id, filtered_index, element_id, {{}} AS l FROM raws)
SELECT doc_id, filtered_index, element_id, array_to_string(list_sort(list_filter(l, lambda x: x IS NOT NULL)), chr(10)) AS fields FROM entries"""
RAW_ALL = _LINES.format("""CASE shape WHEN 0 THEN ['_id=' || element_id, 'id=other', 'pageNumber=' || page_number, 'page_number=0', 'odd=x'] WHEN 1 THEN ['id=' || element_id, '_id=' || element_id, 'page_number=' || page_number, 'type=note']
  ELSE ['_id=' || element_id, 'role=text', 'type=note', 'page_number=9', 'pageNumber=(null)'] END || ['content=' || content]""")
RAW_READY = _LINES.format("""['_id=' || element_id, 'content=' || content, 'elementIndex=' || seq, CASE WHEN shape <> 3 THEN 'pageNumber=' || page_number END, CASE shape WHEN 1 THEN 'elementType=note' WHEN 3 THEN 'elementType=text' END,
  CASE shape WHEN 3 THEN 'role=text' END, CASE WHEN seq % 3 <> 0 THEN 'parentSection=part ' || doc_id END]""")

QUERIES = {f"filter_{p}": partial(_filter, FilterConfig(p)) for p in PRESETS} | {
    "filter_custom": partial(_filter, CUSTOM),
    "element_mappings": element_mappings,
    "filter_metrics": filter_metrics,
    "filter_sizes": filter_sizes,
    "filter_raw_all": partial(_raw, FilterConfig("no_filter")),
    "filter_raw_llm_ready": partial(_raw, FilterConfig("llm_ready")),
    "excluded_fields": excluded_fields,
}
ORACLE_SQL = {f"filter_{p}": _sql(f) for p, f in PRESETS.items()} | {
    "filter_custom": _sql(CUSTOM.fields),
    "element_mappings": f"{KEPT} SELECT doc_id, filtered_index, id AS element_id, coalesce(role, 'unknown') AS element_type, page_number, md5(content) AS content_hash FROM kept",
    "filter_sizes": SIZES,
    "filter_raw_all": RAW_ALL,
    "filter_raw_llm_ready": RAW_READY,
    "filter_metrics": f"""WITH {PARAGRAPHS}, {ELEMENTS}, n AS (SELECT doc_id, count(*) AS total_elements, count(*) FILTER ({BLANK_SAFE} AND id IS NOT NULL) AS filtered_elements FROM elements GROUP BY doc_id)
SELECT *, round((total_elements - filtered_elements) * 100.0::DOUBLE / total_elements, 6) AS dropped_percent FROM n""",
    "excluded_fields": f"""WITH {PARAGRAPHS}, {ELEMENTS}, left_over AS (SELECT doc_id, unnest(keys) AS field FROM elements WHERE {BLANK_SAFE})
SELECT doc_id, string_agg(field, ',' ORDER BY field) AS excluded_fields FROM (SELECT DISTINCT doc_id, field FROM left_over WHERE field NOT IN ('_id', 'id', 'content', 'pageNumber', 'elementIndex', 'pageFooter')) d GROUP BY doc_id""",
}
