"""Filtering and projection of elements, with mappings and metrics.

elements: doc_id, seq (position in reading order), id, content, role, element_type, page_number, keys (array of the
source's field names), and optionally page_header, page_footer, document_metadata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import not_blank, stripped
from leafmill.model import DESCRIPTIONS, PRESETS, FilterConfig
from leafmill.operators.headings import literal_level, parent_section, with_context

#: Columns by field name.
FIELDS = {"_id": "id", "content": "content", "pageNumber": "page_number", "role": "role", "elementType": "element_type", "elementIndex": "element_index", "parentSection": "parent_section", "pageHeader": "page_header", "pageFooter": "page_footer", "documentMetadata": "document_metadata"}
OPTIONAL = ("page_header", "page_footer", "document_metadata")


def presets(spark) -> DataFrame:
    rows = [(n, ",".join(f), DESCRIPTIONS[n]) for n, f in PRESETS.items()]
    return spark.createDataFrame(rows, "preset string, fields string, description string")


def with_sections(elements: DataFrame) -> DataFrame:
    """elements with element_index and parent_section, taken over all elements before any is dropped."""
    for c in OPTIONAL:
        if c not in elements.columns:
            elements = elements.withColumn(c, F.lit(None).cast("string"))
    found = with_context(elements, literal_level(F.col("role")))
    return found.withColumn("element_index", F.col("seq").cast("long")).withColumn("parent_section", parent_section())


def passing(elements: DataFrame) -> DataFrame:
    """Elements that have content that isn't blank."""
    return elements.where(not_blank(F.col("content")))


def named(elements: DataFrame) -> DataFrame:
    """Elements that have an id."""
    return elements.where(F.coalesce(F.col("id"), F.lit("")) != "")


def filter_elements(elements: DataFrame, config: FilterConfig) -> DataFrame:
    """The elements that stay, with doc_id, filtered_index and the fields let through; `*` lets all through.

    If fields match but content is not among them, the stripped content is added.
    """
    fields = config.resolved()
    kept = named(passing(with_sections(elements)))
    kept = kept.withColumn("filtered_index", (F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1).cast("long"))
    if "*" in fields:
        names = [c for c in elements.columns if c not in ("doc_id", "seq", "keys")]
        return kept.select("doc_id", "filtered_index", *names)
    known = [f for f in fields if f in FIELDS and (f != "_id" or config.include_element_ids)]
    if not known:  # nothing matched: an element without content doesn't pass
        return kept.select("doc_id", "filtered_index", F.lit(None).cast("string").alias("content")).where(F.lit(False))
    columns = [F.col(FIELDS[f]) for f in known]
    if "content" not in known:
        columns.append(stripped(F.col("content")).alias("content"))
    return kept.select("doc_id", "filtered_index", *columns)


def element_mappings(elements: DataFrame) -> DataFrame:
    """For each element that stays: its index, id, type, page and the hash of its content."""
    kept = named(passing(elements))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    return kept.select(
        "doc_id",
        index.cast("long").alias("filtered_index"),
        F.col("id").alias("element_id"),
        F.coalesce("role", "type", F.lit("unknown")).alias("element_type") if "type" in kept.columns else F.coalesce("role", F.lit("unknown")).alias("element_type"),
        F.coalesce("page_number", F.lit(0)).cast("long").alias("page_number"),
        F.md5(F.col("content").cast("binary")).alias("content_hash"),
    )


def counts(elements: DataFrame) -> DataFrame:
    """Elements in all and staying, by document, and the share dropped in percent."""
    stays = not_blank(F.col("content")) & (F.coalesce(F.col("id"), F.lit("")) != "")
    found = elements.groupBy("doc_id").agg(F.count("*").alias("total_elements"), F.count_if(stays).alias("filtered_elements"))
    return found.withColumn("dropped_percent", F.round((F.col("total_elements") - F.col("filtered_elements")) * 100.0 / F.col("total_elements"), 6))


def json_text_size(text: Column, ascii_only: bool) -> Column:
    """The length of a string in JSON with its quotes: in bytes, or in characters if all but ASCII is escaped."""
    count = lambda expression: F.regexp_count(text, F.lit(expression))
    own = F.length(text) + 5 * count(r"[^\x00-\x7e]") + 6 * count(r"[\x{10000}-\x{10ffff}]") if ascii_only else F.octet_length(text)
    return own + count(r'["\\\x08\f\n\r\t]') + 5 * count(r"[\x00-\x07\x0b\x0e-\x1f]") + 2


def json_size(elements: DataFrame, fields: list[str], ascii_only: bool = False) -> Column:
    """The length of a JSON object of the fields that are not null; with ascii_only as Python writes it, spaces included."""
    gap = 2 if ascii_only else 1
    kinds = dict(elements.dtypes)
    value = lambda c: json_text_size(F.col(c), ascii_only) if kinds[c] == "string" else F.length(F.col(c).cast("string"))
    parts = [F.when(F.col(c).isNotNull(), value(c) + len(c) + 2 + gap + gap).otherwise(F.lit(0)) for c in fields]
    inside = sum(parts[1:], parts[0])
    return F.lit(2) + F.greatest(inside - gap, F.lit(0))


def sizes(elements: DataFrame) -> DataFrame:
    """By document: bytes of compact JSON lines before and after, the reduction in percent (0 if there was nothing), and
    json_bytes, the length before as Python's json.dumps writes a list (spaces after separators, ASCII escapes)."""
    plain = [c for c in ("id", "content", "role", "element_type", "page_number") if c in elements.columns]
    stays = not_blank(F.col("content")) & (F.coalesce(F.col("id"), F.lit("")) != "")
    whole, short = json_size(elements, plain) + 1, json_size(elements, ["id", "content", "page_number"]) + 1
    found = elements.groupBy("doc_id").agg(
        F.sum(whole).cast("long").alias("original_bytes"),
        F.coalesce(F.sum(F.when(stays, short)), F.lit(0)).cast("long").alias("filtered_bytes"),
        F.sum(json_size(elements, plain, True) + 2).cast("long").alias("json_bytes"),
    )
    return found.withColumn("reduction_percent", F.when(F.col("original_bytes") == 0, 0.0).otherwise((F.col("original_bytes") - F.col("filtered_bytes")) * 100.0 / F.col("original_bytes")))


def raw_elements(rows: DataFrame) -> DataFrame:
    """rows (doc_id, seq, raw: an element's JSON object) with `fields`, its values by key as they stand; not an object: null."""
    return rows.withColumn("fields", F.from_json("raw", "map<string,string>"))


def filter_raw(rows: DataFrame, config: FilterConfig) -> DataFrame:
    """Filtering of elements as raw JSON, so that keys outside any schema pass: doc_id, filtered_index, element_id, fields.

    rows: doc_id, seq, raw, and parent_section. A key that is there counts even if its value is null: the id is `_id`, else
    `id`; the page `pageNumber`, else `page_number`; the type `elementType`, else `role`, else `type`. `*` passes all keys.
    Elements without content or without id are dropped.
    """
    held = raw_elements(rows)
    f = F.col("fields")
    first = lambda *names: F.coalesce(F.get(F.filter(F.array(*[F.struct(F.map_contains_key(f, n).alias("there"), f[n].alias("v")) for n in names]), lambda x: x["there"]), F.lit(0))["v"], F.lit(None).cast("string"))
    element_id = first("_id", "id")
    kept = held.where(f.isNotNull() & not_blank(f["content"])).withColumn("element_id", element_id).where(F.coalesce("element_id", F.lit("")) != "")
    index = (F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1).cast("long")
    fields = config.resolved()
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    if "*" in fields:
        own = F.when(~F.map_contains_key(f, "_id") & F.lit(config.include_element_ids), F.array(entry("_id", F.col("element_id")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
        out = F.concat(F.map_entries(f), own)
    else:
        special = {"_id": F.col("element_id") if config.include_element_ids else None, "pageNumber": first("pageNumber", "page_number"), "elementType": first("elementType", "role", "type"), "parentSection": F.col("parent_section"), "elementIndex": F.col("seq").cast("string")}
        entries = [entry(n, special.get(n, f[n])) for n in fields if special.get(n, n) is not None]
        some = F.filter(F.array(*entries), lambda x: x["value"].isNotNull())
        content = F.array(entry("content", stripped(f["content"])))
        out = F.when((F.size(some) > 0) & ~F.exists(some, lambda x: x["key"] == "content"), F.concat(some, content)).otherwise(some)
    return kept.select("doc_id", index.alias("filtered_index"), "element_id", F.map_from_entries(out).alias("fields"))


def excluded_fields(elements: DataFrame, config: FilterConfig) -> DataFrame:
    """doc_id and the sorted, distinct source fields that no passing element's output has; `_id` is never counted."""
    fields = config.resolved()
    kept = passing(elements)
    emitted = F.col("keys") if "*" in fields else F.array(*[F.lit(f) for f in (*fields, "content", "id")])
    left = kept.select("doc_id", F.explode(F.array_except(F.array_except("keys", emitted), F.array(F.lit("_id")))).alias("field"))
    return left.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("excluded_fields"))
