"""Identifier expressions of layout elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identifier prefix by kind of element.
PREFIX = {"paragraphs": "para", "tables": "table", "cells": "cell", "keyValuePairs": "kv", "lists": "list", "figures": "fig", "formulas": "formula"}


def short_md5(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 6)


def element_id(prefix: str, page: Column, index: Column, content: Column | None = None) -> Column:
    """PREFIX_PAGE_INDEX_HASH, the hash of these and the first 50 characters of the content."""
    head = F.concat_ws("_", F.lit(prefix), page.cast("string"), index.cast("string"))
    text = F.lit("") if content is None else F.substring(F.coalesce(content, F.lit("")), 1, 50)
    return F.concat_ws("_", head, short_md5(F.concat_ws("_", head, text)))


def cell_id(page: Column, table: Column, row: Column, column: Column, content: Column) -> Column:
    """cell_PAGE_TABLE_ROW_COLUMN_HASH, the hash of the content alone."""
    parts = [page, table, F.coalesce(row, F.lit(0)), F.coalesce(column, F.lit(0))]
    return F.concat_ws("_", F.lit("cell"), *[p.cast("string") for p in parts], short_md5(F.coalesce(content, F.lit(""))))


def pair_content(key: Column, value: Column) -> Column:
    return F.concat(F.coalesce(key, F.lit("")), F.lit(":"), F.coalesce(value, F.lit("")))


def region_page(regions: Column) -> Column:
    """The first bounding region's page, or 1."""
    return F.coalesce(F.try_element_at(regions, F.lit(1))["pageNumber"], F.lit(1))
