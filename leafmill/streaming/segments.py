"""Elements and segments of documents that arrive as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafmill.functions.ids import element_id
from leafmill.functions.text import COUNTERS, not_blank
from leafmill.operators.segment import check_limits
from leafmill.session import small_arrow_batches


def stream_elements(documents: DataFrame) -> DataFrame:
    """Paragraph elements of a stream of documents (doc_id, text), without state."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "content")).where(not_blank(F.col("content")))
    return lines.select("doc_id", F.col("seq").cast("long").alias("seq"), "content", element_id("para", F.lit(1), F.col("seq"), F.col("content")).alias("id"), COUNTERS["chars4"](F.col("content")).alias("tokens"))


def stream_segments(elements: DataFrame, least: int, most: int, idle: str | None = None) -> DataFrame:
    """doc_id, seq and segment_id of a stream of elements (doc_id, seq, tokens, level), by the rich rule.

    A document's elements arrive in order of seq over the stream; within a batch they may be mixed. The state of a
    document is its number and tokens of the open segment. With `idle` ("1 day") it goes when the document has been idle for
    that long (processing time), and elements that come later begin at 1 again; Spark then runs batches without data too.
    Without it states are kept, a few bytes for each document ever seen. Null tokens count 0. Of a batch only the numbers seq,
    tokens and level of a document's rows are held at once, to sort them.
    """
    check_limits(least, most)
    small_arrow_batches(elements.sparkSession)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        number, held, filled = state.get if state.exists else (1, 0, False)
        rows = pd.concat([f[["seq", "tokens", "level"]] for f in frames]).sort_values("seq")
        out = []
        for tokens, level in zip(rows["tokens"].fillna(0).astype("int64").tolist(), rows["level"].tolist(), strict=True):
            head = level is not None and level == level and level <= 2
            if filled and held >= least and (head or held + tokens > most):
                number, held = number + 1, 0
            held, filled = held + tokens, True
            out.append(number)
        state.update((number, held, filled))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame({"doc_id": key[0], "seq": rows["seq"].to_numpy(), "segment_id": out})

    return elements.select("doc_id", "seq", "tokens", "level").groupBy("doc_id").applyInPandasWithState(run, "doc_id long, seq long, segment_id int", "number int, held long, filled boolean", "append", timeout)
