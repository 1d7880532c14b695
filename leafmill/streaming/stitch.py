"""Page batches that arrive as a stream, in any order, stitched as they become contiguous.

A document's state is what has been stitched (the next batch's number, code points and highest page so far) and a map of
the batches that wait for an earlier one. A batch that closes the row is given out at once, with those that it frees. If one
is missing, a timer of event time waits `patience` behind the latest batch; when the watermark passes it, the missing numbers
are given out as gaps and stitching goes on with the batches that are there, as the batch form does with a table that
lacks them. A batch that comes after its gap is given out as late, and stitched to nothing.

State is bounded: waiting batches go when they are stitched, at the latest when their timer ends; the three numbers of a
document go with its last batch, where `n_batches` says which that is, and stay otherwise.

Rows: doc_id, batch_no, kind (batch, gap, late), content_offset, page_offset (both null but for batches). Batches that
repeat a number that waits or has been given out are left out as late. Null numbers, lengths and pages are refused by
`require_valid` of the batch form, and are not read here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafmill.session import small_arrow_batches

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "doc_id long, batch_no long, kind string, content_offset long, page_offset long"


class Stitcher(StatefulProcessor):
    """One document's batches."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.so_far = handle.getValueState("so_far", "next long, length long, top long, latest long, last long")
        self.waiting = handle.getMapState("waiting", "batch_no long", "length long, first long, last long")

    def take(self, state: list, key: tuple, number: int, batch: tuple, out: list) -> None:
        """Stitches one batch behind what there is."""
        length, first, last = batch
        offset = 0 if state[2] is None else state[2] + 1 - first
        out.append((key[0], number, "batch", state[1], offset))
        state[0], state[1], state[2] = number + 1, state[1] + length, last + offset

    def free(self, state: list, key: tuple, out: list) -> None:
        """Stitches what waits, as far as it is contiguous."""
        while self.waiting.containsKey((state[0],)):
            number = state[0]
            batch = self.waiting.getValue((number,))
            self.waiting.removeKey((number,))
            self.take(state, key, number, tuple(batch), out)

    def keep(self, state: list, timer: int | None) -> None:
        """Writes the state, or clears it with the last batch; a timer is set where batches wait."""
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if state[4] is not None and state[0] >= state[4] and not self.waiting.exists():
            self.so_far.clear()
            return
        self.so_far.update(tuple(state))
        if timer is not None and self.waiting.exists():
            self.handle.registerTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = list(self.so_far.get()) if self.so_far.exists() else [0, 0, None, 0, None]
        out: list[tuple] = []
        for frame in rows:
            for r in frame.itertuples(index=False):
                number = int(r.batch_no)
                state[3] = max(state[3], int(r.at_ms))
                if r.n_batches == r.n_batches and r.n_batches is not None:
                    state[4] = int(r.n_batches)
                if number < state[0] or self.waiting.containsKey((number,)):
                    out.append((key[0], number, "late", None, None))
                    continue
                self.waiting.updateValue((number,), (int(r.content_length), int(r.first_page), int(r.last_page)))
        self.free(state, key, out)
        self.keep(state, state[3] + self.patience)
        yield frame_of(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, out = list(self.so_far.get()), []
        numbers = sorted(int(k[0]) for k in self.waiting.keys())
        for number in numbers:
            out += [(key[0], n, "gap", None, None) for n in range(state[0], number)]
            batch = self.waiting.getValue((number,))
            self.waiting.removeKey((number,))
            self.take(state, key, number, tuple(batch), out)
        self.keep(state, None)
        yield frame_of(out)

    def close(self) -> None:
        pass


def frame_of(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUT.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    kinds = ("int64", "int64", "object", "Int64", "Int64")
    return pd.DataFrame({n: pd.array(list(c), dtype=k) for n, c, k in zip(names, columns, kinds, strict=True)})


def stream_stitch(batches: DataFrame, patience: str = "10 minutes") -> DataFrame:
    """The rows of a stream of batches: doc_id, batch_no (from 0), content_length, first_page, last_page, at (a timestamp with a
    watermark), and n_batches where it is known."""
    spark = batches.sparkSession
    small_arrow_batches(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    total = F.col("n_batches").cast("long") if "n_batches" in batches.columns else F.lit(None).cast("long")
    rows = batches.select("doc_id", "batch_no", "content_length", "first_page", "last_page", "at", F.unix_millis("at").alias("at_ms"), total.alias("n_batches"))
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)
    return rows.groupBy("doc_id").transformWithStateInPandas(statefulProcessor=Stitcher(wait), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
