"""Batches of a stream: the batch form's rows in any order, gaps behind the watermark, late batches."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import stitch
from leafmill.streaming import stitch as streaming

SCHEMA = "doc_id long, batch_no long, content_length long, first_page long, last_page long, at timestamp, n_batches long"


def run(spark, tmp_path, parts, name, n_batches=True):
    """The rows of a stream of several files, in order."""
    for k, part in enumerate(parts):
        rows = [(*r[:5], r[5], r[6] if n_batches else None) for r in part]
        df = spark.createDataFrame(rows, "doc_id long, batch_no long, content_length long, first_page long, last_page long, s long, n_batches long")
        df.select(*df.columns[:5], F.timestamp_seconds("s").alias("at"), "n_batches").coalesce(1).write.parquet(str(tmp_path / f"in/{k:03d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = streaming.stream_stitch(stream.withWatermark("at", "1 second"), "60 seconds")
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    return [tuple(r) for r in spark.sql(f"select * from {name}").collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_the_batch_form(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = []
    for doc in range(6):
        n = rng.randint(1, 6)
        for b in range(n):
            first = rng.randint(1, 9)
            rows.append((doc, b, rng.randint(0, 500), first, first + rng.randint(0, 3), 10, n))
    rng.shuffle(rows)
    got = run(spark, tmp_path, [rows[k::4] for k in range(4)], f"any{seed}")
    table = spark.createDataFrame([r[:5] for r in rows], "doc_id long, batch_no long, content_length long, first_page long, last_page long")
    expected = sorted((r["doc_id"], r["batch_no"], "batch", r["content_offset"], r["page_offset"]) for r in stitch.batch_offsets(table).collect())
    assert sorted(got) == expected


def test_gaps_and_late_batches(spark, tmp_path):
    parts = [
        [(1, 0, 10, 1, 2, 10, 5), (1, 3, 7, 1, 1, 11, 5), (2, 0, 5, 4, 4, 10, None)],
        [(2, 1, 5, 1, 1, 300, None)],  # the watermark passes document 1's timer
        [(2, 2, 5, 1, 1, 301, None)],
        [(1, 1, 9, 1, 1, 302, 5), (1, 4, 3, 2, 3, 302, 5), (2, 2, 5, 1, 1, 302, None)],
    ]
    got = run(spark, tmp_path, parts, "gaps")
    assert sorted(r[1:] for r in got if r[0] == 1) == [(0, "batch", 0, 0), (1, "gap", None, None), (1, "late", None, None), (2, "gap", None, None), (3, "batch", 10, 2), (4, "batch", 17, 2)]
    assert sorted(r[1:] for r in got if r[0] == 2) == [(0, "batch", 0, 0), (1, "batch", 5, 4), (2, "batch", 10, 5), (2, "late", None, None)]
