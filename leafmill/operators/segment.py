"""Greedy segmentation of ordered elements by token counts and headings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import small_arrow_batches


def check_limits(least: int, most: int) -> None:
    if least <= 0 or most <= 0 or least >= most:
        raise ValueError("limits are positive, the least below the most")


def number_segments(elements: DataFrame, least: int, most: int, rule: str, key: str = "doc_id", skip_faulty: bool = False) -> DataFrame:
    """elements with segment_id; they have key, seq, tokens and level.

    Elements whose tokens could not be counted (null) count 0, or with skip_faulty are left out and change nothing.

    rule "rich": a segment of at least `least` tokens ends before a heading of level 1 or 2, or before what takes it over
    `most`; numbers begin at 1. rule "filtered": it ends before what takes it over `most`, whatever it holds, or, of at
    least `least` tokens, before such a heading; numbers begin at 0.

    The rule depends on the tokens since the last cut, a fold over a document's rows; rows are streamed in order, with one
    counter as state. A window function asks for that order, so rows already dealt by key are not shuffled again.
    """
    check_limits(least, most)
    if rule not in ("rich", "filtered"):
        raise ValueError("rule is rich or filtered")
    small_arrow_batches(elements.sparkSession)
    if skip_faulty:
        elements = elements.where("tokens is not null")
    rich = rule == "rich"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, number, begun = None, 0, 0, False
        for b in batches:
            out = []
            for k, tokens, level in zip(*(b.column(c).to_pylist() for c in (key, "tokens", "level")), strict=True):
                tokens = tokens or 0
                if not begun or k != current:
                    current, held, number, begun = k, 0, int(rich), True
                    filled = False
                head = level is not None and level <= 2
                over = held + tokens > most
                if filled and (held >= least and (head or over) if rich else over or (held >= least and head)):
                    number, held = number + 1, 0
                held += tokens
                filled = True
                out.append(number)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.int32())], names=[*names, "segment_id"])

    names = elements.columns
    ordered = elements.withColumn("__place", F.row_number().over(Window.partitionBy(key).orderBy("seq")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in elements.schema.fields)
    return ordered.mapInArrow(run, f"{schema}, segment_id int")


def segments(numbered: DataFrame, rule: str, key: str = "doc_id", compatible: bool = True) -> DataFrame:
    """A row for each segment: n_elements, token_count, first_seq, last_seq and its headings h1 to h6.

    Rich segments report the headings after their last element. Filtered ones report those at the first element of the
    next segment (the last one its own last), or with compatible=False those after their own last element.
    """
    heads = [f"h{k}" for k in range(1, 7)]
    found = numbered.groupBy(key, "segment_id").agg(
        F.count("*").alias("n_elements"),
        F.sum("tokens").alias("token_count"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.max_by(F.struct(*heads), "seq").alias("__last"),
        F.min_by(F.struct(*heads), "seq").alias("__first"),
    )
    if rule == "filtered" and compatible:
        found = found.withColumn("__last", F.coalesce(F.lead("__first").over(Window.partitionBy(key).orderBy("segment_id")), F.col("__last")))
    return found.select(key, "segment_id", "n_elements", "token_count", "first_seq", "last_seq", *[F.col(f"__last.{h}").alias(h) for h in heads])


def segment_mappings(mappings: DataFrame, numbered: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mappings whose id stands in a segment: key, segment_id and the mapping's columns; once for each such segment."""
    ids = numbered.select(key, "segment_id", F.col("id").alias("element_id")).distinct()
    return mappings.join(ids, [key, "element_id"])
