"""Text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token counters by name; each takes a text column. `pretoken` counts the pieces of a public byte-pair pattern.
PIECES = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"
COUNTERS: dict[str, Callable[[Column], Column]] = {
    "chars4": lambda c: F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("long"),
    "pretoken": lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit(PIECES)).cast("long"),
}


def not_blank(text: Column) -> Column:
    """If anything but Unicode white space and U+001C to U+001F is there; false for null."""
    return F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def occurrences(text: Column, marker: Column) -> Column:
    """Non-overlapping occurrences of a literal; 0 for an empty one."""
    n = F.length(text) - F.length(F.replace(text, marker, F.lit("")))
    return F.when(F.length(marker) > 0, (n / F.length(marker)).cast("long")).otherwise(F.lit(0).cast("long"))


def similarity(a: Column, b: Column) -> Column:
    """Mean of the length ratio and the Jaccard similarity of lower-case words in the first 1000 characters; 0 if either
    text is empty."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.substring(c, 1, 1000)), r"(?U)\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    joint = F.size(F.array_union(x, y))
    jaccard = F.when(joint > 0, F.size(F.array_intersect(x, y)) / joint).otherwise(F.lit(0.0))
    ratio = 1 - F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b))
    some = (F.length(F.coalesce(a, F.lit(""))) > 0) & (F.length(F.coalesce(b, F.lit(""))) > 0)
    return F.when(some, (ratio + jaccard) / 2).otherwise(F.lit(0.0))


def lossy_utf8(raw: Column) -> Column:
    """Bytes as text, what is not UTF-8 replaced."""
    return F.make_valid_utf8(raw.cast("string"))
