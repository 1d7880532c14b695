"""Streams give what batches give."""

from pyspark.sql import functions as F

from leafmill.operators import headings, segment
from leafmill.plans.inputs import paragraphs
from leafmill.streaming import segments


def test_segments_of_a_stream(spark, sf, tmp_path):
    p = paragraphs(spark, sf).where("doc_id < 20").withColumn("tokens", F.ceil(F.length("content") / 4)).withColumn("level", headings.heading_level(F.col("role"))).select("doc_id", "seq", "tokens", "level")
    for k, part in enumerate(("seq < 3", "seq >= 3 and seq < 6", "seq >= 6")):
        p.where(part).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = segments.stream_segments(stream, 100, 300).writeStream.format("memory").queryName("cut").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("select doc_id, seq, segment_id from cut").collect())
    batch = segment.number_segments(p, 100, 300, "rich")
    assert got == sorted((r["doc_id"], r["seq"], r["segment_id"]) for r in batch.collect()) and got


def test_elements_of_a_stream(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = segments.stream_elements(stream).writeStream.format("memory").queryName("parts").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("parts").count() == segments.stream_elements(docs).count() > 0
