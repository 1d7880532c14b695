"""Spans met with the spans that hold them, by bins: a join on intervals without comparing all pairs.

Each span lies in the bins of `width` that it touches; spans meet on (key, bin), and a pair is given out only in the bin where
the later of its two starts lies, so once. A bin of many spans is no hot key: one side's rows are dealt over `split` salts and
the other side's repeated, where more than `heavy` rows of the first lie in a bin (counted first, and few by nature).

Defined results: spans are half open (start, end), empty ones hold and meet nothing, null bounds or keys meet nothing; pairs
of rows that repeat repeat; a whole table of one key and place is split as a heavy bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.session import few


def binned(rows: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    """rows with `bin` for each bin that a span touches."""
    first, last = F.floor(start / width), F.floor((end - 1) / width)
    return rows.where(end > start).withColumn("bin", F.explode(F.sequence(first, last)))


def overlapping(left: DataFrame, right: DataFrame, key: str = "doc_id", width: int = 1024, heavy: int = 50_000, split: int = 16) -> DataFrame:
    """All pairs of rows of left and right of one key whose spans overlap: struct columns `l` and `r`.

    left and right have key, start and end.
    """
    boxed = lambda t, n: t.select(F.struct(*[F.col(f"`{c}`") for c in t.columns]).alias(n), F.col(key).alias("k"), F.col("start").alias(f"{n}s"), F.col("end").alias(f"{n}e"))
    a = binned(boxed(left, "l"), F.col("ls"), F.col("le"), width)
    b = binned(boxed(right, "r"), F.col("rs"), F.col("re"), width)
    crowded = few(a.groupBy("k", "bin").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("k", "bin", F.lit(split).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = a.join(crowded, ["k", "bin"], "left").withColumn("salt", F.pmod(F.xxhash64("l"), parts).cast("int")).drop("parts")
    spread = b.join(crowded, ["k", "bin"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    met = dealt.join(spread, ["k", "bin", "salt"])
    own = F.col("bin") == F.floor(F.greatest("ls", "rs") / width)
    return met.where(own & (F.col("ls") < F.col("re")) & (F.col("rs") < F.col("le"))).select("l", "r")
