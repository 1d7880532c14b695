"""Windows of streams equal those of tables, late events included up to the watermark; intervals equal all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import intervals
from leafmill.streaming import windows

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.mark.parametrize("name", ["sessions", "sliding"])
def test_streams_give_what_tables_give(spark, sf, tmp_path, name):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    make = (lambda e: windows.sessions(e, "2 hours", late="2 days")) if name == "sessions" else (lambda e: windows.sliding(e, "6 hours", "2 hours", late="2 days"))
    first = events.agg(F.min("ts")).first()[0]
    mixed = events.withColumn("part", F.floor((F.unix_timestamp("ts") - int(first.timestamp())) / 86400 / 7) + F.pmod("event_id", F.lit(2)) * 0)
    for k in range(5):
        mixed.where(F.col("part") == k).drop("part").orderBy(F.rand(3)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    end = events.limit(1).withColumn("ts", F.expr("timestamp'2031-01-01'")).withColumn("user_id", F.lit(-1).cast("long"))
    end.coalesce(1).write.parquet(str(tmp_path / "in/9"))
    far_late = events.limit(1).withColumn("ts", F.expr("timestamp'2001-01-01'")).withColumn("user_id", F.lit(-2).cast("long"))
    far_late.coalesce(1).write.parquet(str(tmp_path / "in/99"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(f"w_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql(f"select * from w_{name}").where("start < timestamp'2030-01-01'").collect())
    expected = sorted(tuple(r) for r in make(events).collect())
    assert got == expected and len(got) > 10


@pytest.mark.parametrize("heavy", [50_000, 3])
def test_intervals_equal_all_pairs(spark, heavy):
    rng = random.Random(heavy)
    some = lambda n: [(rng.choice(["a", "b", None]), (s := rng.randint(0, 200)), s + rng.choice([0, 1, 5, 60]), i) for i in range(n)] + [("a", None, 5, -1)]
    left, right = some(60), some(40)
    schema = "doc_id string, start long, end long, bin long"
    met = intervals.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), width=16, heavy=heavy, split=3)
    got = sorted((r["l"]["bin"], r["r"]["bin"]) for r in met.collect())
    ok = lambda x, y: x[0] is not None and x[0] == y[0] and x[1] is not None and y[1] is not None and x[2] > x[1] and y[2] > y[1] and x[1] < y[2] and y[1] < x[2]
    assert got == sorted((x[3], y[3]) for x in left for y in right if ok(x, y)) and got
    assert intervals.overlapping(spark.createDataFrame([], schema), spark.createDataFrame(right, schema)).count() == 0
