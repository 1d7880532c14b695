"""Layout JSON: reading documents, and their parts as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<offset:int,length:int>"
REGIONS = "array<struct<pageNumber:int,polygon:array<double>>>"
TEXT = f"_id:string,id:string,page_number:int,content:string,role:string,pageNumber:int,spans:array<{SPAN}>,span:{SPAN},boundingRegions:{REGIONS}"
CELL = "struct<_id:string,kind:string,rowIndex:int,columnIndex:int,content:string>"
TABLE = f"{TEXT},rowCount:int,columnCount:int,cells:array<{CELL}>"
SIDE = f"struct<content:string,boundingRegions:{REGIONS}>"
FORMULA = f"_id:string,value:string,kind:string,pageNumber:int,span:{SPAN},spans:array<{SPAN}>,boundingRegions:{REGIONS}"
ELEMENTS = f"paragraphs:array<struct<{TEXT}>>,tables:array<struct<{TABLE}>>,figures:array<struct<{TEXT}>>,formulas:array<struct<{FORMULA}>>"
PAGE = f"struct<pageNumber:int,words:array<struct<{TEXT}>>,lines:array<struct<{TEXT}>>,{ELEMENTS}>"
SCHEMA = f"content string, pages array<{PAGE}>, paragraphs array<struct<{TEXT}>>, tables array<struct<{TABLE}>>, figures array<struct<{TEXT}>>, formulas array<struct<{FORMULA}>>, lists array<struct<{TEXT}>>, keyValuePairs array<struct<_id:string,key:{SIDE},value:{SIDE}>>"

#: Files that the local extractor takes (fixed values).
SUFFIXES = (".pdf", ".docx", ".doc", ".pptx", ".html", ".md")
MOST_BYTES = 100 * 1024 * 1024


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """source_file, raw (the JSON as it is) and doc (parsed) of each file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("raw"))
    return parse(files)


def parse(files: DataFrame) -> DataFrame:
    """files with doc, parsed from raw."""
    return files.withColumn("doc", F.from_json("raw", SCHEMA))


def elements(documents: DataFrame, key: str = "source_file") -> DataFrame:
    """The parts of parsed documents as rows for `unnest` and identifiers.

    doc_id, scope, kind, page_idx, page_number, own_page, region_page, arr_idx, id, role, content, offset, keys.
    """
    raw_keys = lambda path: F.expr(f"json_object_keys(get_json_object(raw, {path}))")
    base = documents.select(F.col(key).alias("doc_id"), "raw", "doc")
    out = None

    def add(rows: DataFrame, scope: str, kind: str, place) -> None:
        nonlocal out
        e = F.col("e")
        names = set(rows.schema["e"].dataType.names)
        get = lambda n, t="string": e[n] if n in names else F.lit(None).cast(t)
        region = F.try_element_at(e["boundingRegions"], F.lit(1))["pageNumber"] if "boundingRegions" in names else F.lit(None).cast("int")
        spans = F.try_element_at(e["spans"], F.lit(1))["offset"] if "spans" in names else F.lit(None).cast("int")
        content = e["value"] if kind == "formulas" else get("content") if kind != "keyValuePairs" else F.lit(None).cast("string")
        value = rows.select(
            "doc_id", F.lit(scope).alias("scope"), F.lit(kind).alias("kind"), "page_idx", "page_number", F.coalesce(get("pageNumber", "int"), get("page_number", "int")).alias("own_page"), region.alias("region_page"),
            "arr_idx", F.coalesce(get("_id"), get("id")).alias("id"), get("role").alias("role"), content.alias("content"), F.coalesce(spans, e["span"]["offset"] if "span" in names else F.lit(None).cast("int"), F.lit(0)).alias("offset"),
            raw_keys(place).alias("keys"),
        )
        out = value if out is None else out.unionByName(value)

    pages = base.select("doc_id", "raw", F.posexplode("doc.pages").alias("page_idx", "p"))
    for kind in ("words", "lines", "paragraphs", "tables", "figures", "formulas"):
        rows = pages.select("doc_id", "raw", "page_idx", F.col("p.pageNumber").alias("page_number"), F.posexplode(f"p.{kind}").alias("arr_idx", "e"))
        add(rows, "page", kind, f"concat('$.pages[', page_idx, '].{kind}[', arr_idx, ']')")
    for kind in ("paragraphs", "tables", "figures", "formulas", "lists", "keyValuePairs"):
        rows = base.select("doc_id", "raw", F.lit(None).cast("int").alias("page_idx"), F.lit(None).cast("int").alias("page_number"), F.posexplode(f"doc.{kind}").alias("arr_idx", "e"))
        add(rows, "doc", kind, f"concat('$.{kind}[', arr_idx, ']')")
    return out


def acceptable(files: DataFrame) -> DataFrame:
    """files (path, length) with `fault`: an unsupported suffix, too large, or null."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return files.withColumn("fault", F.when(~suffix.isin(*SUFFIXES), "unsupported format").when(F.col("length") > MOST_BYTES, "too large"))


def structure_flags(documents: DataFrame) -> DataFrame:
    """The top-level keys of each document's JSON, sorted, as one string."""
    return documents.withColumn("keys", F.array_join(F.array_sort(F.expr("json_object_keys(raw)")), ","))


def page_counts(files: DataFrame, counter, key: str = "path") -> DataFrame:
    """key and n_pages of files (key, body) through a caller's counter: a function of a file's bytes (a PDF reader, say).

    Bytes that it can't read (it raises ValueError) have null pages.
    """
    import pandas as pd

    def run(frames):
        for f in frames:
            found = []
            for body in f["body"]:
                try:
                    found.append(counter(body))
                except ValueError:
                    found.append(None)
            yield pd.DataFrame({key: f[key], "n_pages": pd.array(found, dtype="Int64")})

    return files.select(key, "body").mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, n_pages long")


def extract(ranges: DataFrame, extractor, schema: str) -> DataFrame:
    """Page ranges through a caller's extractor: a function of an iterator of pandas frames (a layout or OCR service)."""
    return ranges.mapInPandas(extractor, schema)


def write_json(frame: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines, in a folder for each value of `by`."""
    writer = frame.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)
