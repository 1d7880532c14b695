"""HTML, Markdown and plain text as ordered elements, natively.

Elements: doc_id, seq, kind (heading, paragraph, list, table), level (of a heading), content. Marks inside a block are
taken out, white space runs become one space, blank blocks are dropped.

Defined results: null text gives no rows; markup is read leniently, block by block, not checked; tables and lists give a
row for each row or item; what stands in script, style, head, nav, footer and comments is no content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Named character references that are resolved.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
HIDDEN = r"(?is)<!--.*?-->|" + "|".join(rf"<{t}\b.*?</{t}\s*>" for t in ("script", "style", "head", "nav", "footer"))
TAGS = "h[1-6]|p|li|tr|div|article|section|blockquote|pre|table|ul|ol"
BREAK = "\x1e"


def plain(markup: Column) -> Column:
    """Text of a block of HTML."""
    text = F.regexp_replace(F.regexp_replace(markup, r"(?i)<br\b[^>]*>|</t[dh]\s*>", " "), r"<[^>]*>", "")
    for name, c in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(c))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_elements(documents: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """key, seq, kind, level, content of the blocks of HTML documents."""
    shown = F.regexp_replace(F.replace(F.col(html), F.lit(BREAK), F.lit(" ")), HIDDEN, "")
    cut = F.regexp_replace(F.regexp_replace(shown, rf"(?i)(<(?:{TAGS})\b)", BREAK + "$1"), rf"(?i)</(?:{TAGS})\s*>", BREAK)
    blocks = documents.select(F.col(key), F.posexplode(F.split(cut, BREAK)).alias("at", "block"))
    tag = F.lower(F.regexp_extract("block", r"^<([A-Za-z][A-Za-z0-9]*)", 1))
    level = F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int"))
    kind = F.when(level.isNotNull(), "heading").when(tag == "li", "list").when(tag == "tr", "table").otherwise("paragraph")
    return numbered(blocks.select(key, "at", kind.alias("kind"), level.alias("level"), plain(F.col("block")).alias("content")), key)


def markdown_elements(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, seq, kind, level, content of Markdown: ATX headings, list items, table rows, and paragraphs between blank lines."""
    lines = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    apart = F.regexp_replace(lines, r"(?m)^([ \t]{0,3}(?:#{1,6}[ \t].*|(?:[-*+]|\d+[.)])[ \t].*|\|.*))$", "\n\n$1\n\n")
    blocks = documents.select(F.col(key), F.posexplode(F.split(apart, r"\n[ \t]*\n")).alias("at", "block"))
    block = F.regexp_replace(F.trim(F.regexp_replace("block", r"\s+", " ")), r"^\s+|\s+$", "")
    marks = F.regexp_extract(block, r"^(#{1,6}) ", 1)
    level = F.when(marks != "", F.length(marks).cast("int"))
    kind = F.when(level.isNotNull(), "heading").when(block.rlike(r"^(?:[-*+]|\d+[.)]) "), "list").when(block.startswith("|"), "table").otherwise("paragraph")
    content = F.when(kind == "table", F.when(block.rlike(r"^[|:\- ]+$"), "").otherwise(F.trim(F.regexp_replace(block, r"\s*\|\s*", " ")))).otherwise(F.regexp_replace(block, r"^(?:#{1,6}|[-*+]|\d+[.)]) (.*?)(?: #+)?$", "$1"))
    return numbered(blocks.select(key, "at", kind.alias("kind"), level.alias("level"), content.alias("content")), key)


def text_elements(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, seq, kind, level, content of plain text: a paragraph for each line."""
    lines = documents.select(F.col(key), F.posexplode(F.split(F.col(text), r"\r\n?|\n")).alias("at", "block"))
    return numbered(lines.select(key, "at", F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), F.trim(F.regexp_replace("block", r"\s+", " ")).alias("content")), key)


def numbered(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks that are not blank; seq is a block's place, which grows but may leave gaps."""
    return blocks.where("content <> ''").select(key, F.col("at").cast("long").alias("seq"), "kind", "level", "content")


def read_markup(files: DataFrame) -> DataFrame:
    """Elements of files (path, text) by their suffix: .html and .htm, .md, and plain text; doc_id is the path."""
    held = files.select(F.col("path").alias("doc_id"), "text", F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("suffix"))
    web = html_elements(held.where("suffix in ('.html', '.htm')"), html="text")
    marked = markdown_elements(held.where("suffix = '.md'"))
    return web.unionByName(marked).unionByName(text_elements(held.where("suffix not in ('.html', '.htm', '.md')")))


def element_statistics(elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, and how many elements of each kind a document has."""
    kinds = ("heading", "paragraph", "list", "table")
    return elements.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in kinds])


def local_statistics(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pages, and the elements by type that a locally extracted document (`raw`, JSON) lists, on its pages and at its top.

    Text at the top is a heading or a paragraph by `is_heading`; types that are not counted are left out.
    """
    types = ("text", "table", "list", "figure", "heading", "paragraph")
    element = "struct<type:string,is_heading:boolean>"
    doc = F.from_json(F.col("raw"), f"docling_document struct<pages:map<string,struct<elements:array<{element}>>>,elements:map<string,{element}>>")["docling_document"]
    on_pages = F.coalesce(F.flatten(F.transform(F.map_values(doc["pages"]), lambda p: F.coalesce(F.transform(p["elements"], lambda e: F.coalesce(e["type"], F.lit("unknown"))), F.array().cast("array<string>")))), F.array().cast("array<string>"))
    top = F.coalesce(F.transform(F.map_values(doc["elements"]), lambda e: F.when(e["type"] == "text", F.when(e["is_heading"], F.lit("heading")).otherwise(F.lit("paragraph"))).otherwise(F.coalesce(e["type"], F.lit("unknown")))), F.array().cast("array<string>"))
    held = documents.select(key, F.coalesce(F.size(doc["pages"]), F.lit(0)).alias("pages"), F.concat(on_pages, top).alias("found"))
    number = lambda t: F.size(F.filter("found", lambda x: x == t)).alias(t)
    return held.select(key, F.greatest("pages", F.lit(0)).alias("pages"), *map(number, types))
