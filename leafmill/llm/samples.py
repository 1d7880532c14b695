"""Samples of labelled texts for training, of a bounded size whatever the table holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from leafmill.session import few, small_arrow_batches


def one_per_bucket(docs: DataFrame, known: DataFrame, per_label: int, cut: Callable[[object, str | None], str], on: list[str]) -> list[Row]:
    """At most per_label rows (doc_id, label, text) of each label, each text cut to a piece, sorted by doc_id and text.

    known has doc_id and label; docs has text and the columns `on`, by which both meet. Each label's doc_ids are dealt to
    per_label buckets by hash, and a bucket takes the least (hash of doc_id, hash of text): a map-side minimum, first of
    ids and then of what rows of these ids hold, so that an id which many rows repeat brings one row. Null doc_ids and
    labels are left out.
    """
    small_arrow_batches(docs.sparkSession)
    h = F.xxhash64("doc_id")
    least = F.min(F.struct(h.alias("h"), F.col("doc_id"))).alias("m")
    held = known.where("doc_id is not null and label is not null")
    chosen = held.groupBy("label", F.pmod(h, F.lit(per_label)).alias("bucket")).agg(least).select("label", "bucket", F.col("m.doc_id").alias("doc_id"))
    rows = docs.join(few(chosen), on).select("doc_id", "label", "bucket", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [cut(i, t) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            names = ["doc_id", "label", "bucket"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.string())], names=[*names, "text"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "label", "bucket"))
    pieces = rows.mapInArrow(run, f"{kinds}, text string")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"), F.col("doc_id"))).alias("m")
    found = pieces.groupBy("label", "bucket").agg(one).select("m.doc_id", "label", "m.text").collect()
    return sorted(found, key=lambda r: (r["doc_id"], str(r["label"]), r["text"]))
