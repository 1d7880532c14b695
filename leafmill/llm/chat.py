"""Chat formatting into budgeted training windows.

A conversation's turns are cut into turn-aligned spans by the prefix sums of their tokens: a span ends before the first
turn that would take the window over its budget. A window repeats the conversation's first system turn and as many of
the turns before its span as fit the history budget, then holds the span. The loss mask covers the texts of assistant
turns of the span alone, so repeated targets are masked out and each assistant text is under the mask exactly once.

Turn: <|im_start|>ROLE newline TEXT<|im_end|> newline. Inside texts and roles a backslash is put after the < of any
"<|", "<\\|", "<\\\\|" and so on, so no control string is left and taking one backslash away restores the text; a
newline in a role is written as \\n.

Rows of a conversation are sorted and streamed through one task; the task holds one window at a time, so a conversation
of any length needs no more memory than its windows (spilling sort, constant state). A span opens with room for its first
turn: the system turn is left out of that window if the turn fits only without it, and the oldest repeated turns go until
the turn fits. A turn is never split, so a window is over the budget only if it holds a single own turn that is over the budget alone.

Defined results: null role or text is empty; rows go by turn (nulls first), ties by role and text, repeated rows repeat;
a null conv_id is one conversation; conv_id has any type that can be sorted; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leafmill.session import small_arrow_batches

START, STOP = "<|im_start|>", "<|im_end|>"
_ESCAPE, _RESTORE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE_PLAIN, _ROLE_RESTORE = re.compile(r"[\\\n]"), re.compile(r"\\(.)")
WINDOW = "window int, n_tokens long, repeated int, text string, loss array<struct<start:int,end:int>>"
BATCH_CHARS = 2_000_000


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def restore(text: str) -> str:
    return _RESTORE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(_ROLE_PLAIN.sub(lambda m: "\\n" if m[0] == "\n" else "\\\\", role))


def restore_role(role: str) -> str:
    return _ROLE_RESTORE.sub(lambda m: "\n" if m[1] == "n" else m[1], restore(role))


def byte_tokens(text: str) -> int:
    """A quarter of the bytes, rounded up, and four for the turn's marks."""
    return -(-len(text.encode("utf-8", "replace")) // 4) + 4


class Windows:
    """Takes the turns of one conversation in order and gives its windows."""

    def __init__(self, budget: int, history: int, tokens: Callable[[str], int]):
        self.budget, self.history, self.tokens = budget, history, tokens
        self.system: tuple | None = None
        self.before: list[tuple] = []  # the latest turns, within the history budget
        self.span: list[tuple] = []
        self.total = self.span_from = self.count = 0  # prefix sums of tokens
        self.led = True  # by the system turn

    def repeated(self) -> list[tuple]:
        head = [self.system] if self.system and self.led and self.system not in self.span and self.system not in self.before else []
        return head + self.before

    def make_room(self, n: int) -> None:
        """Leave out of a window that opens with a turn of n tokens what would take it over the budget."""
        self.led = n > self.budget or n + (self.system[3] if self.system else 0) <= self.budget
        while self.before and sum(t[3] for t in self.repeated()) + n > self.budget:
            self.before.pop(0)

    def close(self) -> dict:
        again, parts, loss, at = self.repeated(), [], [], 0
        for k, (_, role, text, _n) in enumerate(again + self.span):
            head, body = f"{START}{escape_role(role)}\n", escape(text)
            if k >= len(again) and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts += [head, body, STOP, "\n"]
            at += len(head) + len(body) + len(STOP) + 1
        out = {"window": self.count, "n_tokens": sum(t[3] for t in again) + self.total - self.span_from, "repeated": len(again), "text": "".join(parts), "loss": loss}
        held, kept = 0, []
        for turn in reversed(self.before + self.span):
            held += turn[3]
            if held > self.history:
                break
            kept.append(turn)
        self.before, self.span, self.span_from, self.count = kept[::-1], [], self.total, self.count + 1
        return out

    def add(self, number: int, role: str, text: str) -> dict | None:
        """The window that this turn closes, if any."""
        n, out = self.tokens(text), None
        if self.span and sum(t[3] for t in self.repeated()) + self.total + n - self.span_from > self.budget:
            out = self.close()
        if not self.span:
            self.make_room(n)
        turn = (number, role, text, n)
        self.span.append(turn)
        self.total += n
        if self.system is None and role == "system":
            self.system = turn
        return out


def windows(conversations: DataFrame, budget: int = 1024, history: int = 256, tokens: Callable[[str], int] = byte_tokens) -> DataFrame:
    """The windows of all conversations; those of one stand in order within one partition."""
    if not 0 <= history < budget:
        raise ValueError("the history budget is at least 0 and below the window's")
    small_arrow_batches(conversations.sparkSession)
    rows = conversations.select("conv_id", F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType
    fields = [pa.field("conv_id", to_arrow_type(kind)), pa.field("window", pa.int32()), pa.field("n_tokens", pa.int64()), pa.field("repeated", pa.int32()), pa.field("text", pa.string()), pa.field("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, ready, size, number = None, None, [], 0, 0
        for b in batches:
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        ready.append({"conv_id": current, **state.close()})
                    current, state = conv, Windows(budget, history, tokens)
                number += 1
                if (w := state.add(number, role, text)) is not None:
                    ready.append({"conv_id": current, **w})
                size += len(text)
                if size >= BATCH_CHARS and ready:
                    yield pa.RecordBatch.from_pylist(ready, schema=pa.schema(fields))
                    ready, size = [], 0
        if state is not None:
            ready.append({"conv_id": current, **state.close()})
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=pa.schema(fields))

    return ordered.mapInArrow(run, f"conv_id {kind.simpleString()}, {WINDOW}")


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    found = []
    for part in text.split(START)[1:]:
        role, _, body = part.partition("\n")
        found.append((restore_role(role), restore(body[: -len(STOP) - 1])))
    return found


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what its windows say, read back from their texts and loss spans.

    Takes the rows as `windows` leaves them: a narrow step, so each partition holds a conversation's windows in order.
    """
    kind = formatted.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> list:
            return [current, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_windows]

        current, begun, done = None, False, []
        for b in batches:
            for conv, again, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "repeated", "text", "loss")), strict=True):
                if not begun or conv != current:
                    if begun:
                        done.append(row())
                    current, begun, turns, loss = conv, True, hashlib.sha256(), hashlib.sha256()
                    n_turns = loss_chars = chars = n_windows = 0
                for role, said in read_turns(text)[again:]:
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                    n_turns += 1
                for s in spans:
                    target = restore(text[s["start"] : s["end"]])
                    loss.update(target.encode("utf-8", "replace"))
                    loss_chars += len(target)
                chars += len(text)
                n_windows += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row(), schema, strict=True)], schema=schema)

    return formatted.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(windows(rows.unionByName(planted)))
