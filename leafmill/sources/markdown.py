"""Markdown as blocks, by a state machine over lines: open containers, and one open leaf.

Each line first goes on with the open containers (a quote by its mark, an item by its indent), may open new ones, and gives
the rest to the leaf: a heading (with marks before it or a line under it), a fence, indented code, a rule, a table or a
paragraph. A paragraph goes on over a line that lacks its containers' marks, if the line begins no block (a lazy line).

Blocks: key, seq (dense), kind (heading, paragraph, code, table, rule), level, quote_depth, list_depth, item, ordered, row, info,
first_line, last_line (from 1), content. item is the innermost item's number in its list, in which list_depth counts all
lists; a table gives a row for each of its rows, cells joined by tabs; info is what a fence is marked with. Content keeps
inline marks as they are; lines of a paragraph are joined by newlines without their indents, code keeps its own.

Defined results: null and blank texts give no rows; every text is read, nothing is an error; lines end at newlines,
carriage returns or both; HTML blocks and link definitions are read as paragraphs; a fence that never ends reaches to the
end of its container; rows that repeat are read alike; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import small_arrow_batches

ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*?)[ \t]*$")
MARK = re.compile(r"([-+*]|\d{1,9}[.)])(?=[ \t]|$)")
RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
UNDER = re.compile(r"(=+|-+)[ \t]*$")
DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
COLUMNS = ("kind", "level", "quote_depth", "list_depth", "item", "ordered", "row", "info", "first_line", "last_line", "content")
SCHEMA = (
    "seq long, kind string, level int, quote_depth int, list_depth int, item int, ordered boolean, row int, info string, "
    "first_line int, last_line int, content string"
)


@dataclass
class Container:
    """A quote or an item; `series` is the mark and number of the last item directly in it."""

    indent: int = -1  # of an item's content; -1 of quotes
    number: int = 0
    ordered: bool = False
    empty: bool = False  # an item that began with a blank line and has nothing yet
    series: tuple[str, int] | None = None


@dataclass
class Leaf:
    kind: str
    first: int
    last: int
    lines: list[str] = field(default_factory=list)
    mark: str = ""  # of a fence
    indent: int = 0
    info: str | None = None


def cells(line: str) -> list[str]:
    """The cells of a table's row; a pipe after a backslash is none's end."""
    cut = re.split(r"(?<!\\)\|", line.strip().removeprefix("|"))
    if len(cut) > 1 and not cut[-1].strip():
        cut.pop()
    return [c.strip().replace("\\|", "|") for c in cut]


class Reader:
    """Takes lines in order and collects blocks in `rows`."""

    def __init__(self) -> None:
        self.root = Container()
        self.open: list[Container] = []
        self.leaf: Leaf | None = None
        self.rows: list[tuple] = []

    def emit(self, kind: str, first: int, last: int, content: str, level: int | None = None, row: int | None = None, info: str | None = None) -> None:
        items = [c for c in self.open if c.indent >= 0]
        item = items[-1] if items else None
        self.rows.append((kind, level, len(self.open) - len(items), len(items), item and item.number, item and item.ordered, row, info, first, last, content))

    def end_leaf(self) -> None:
        leaf, self.leaf = self.leaf, None
        if leaf is None:
            return
        if leaf.kind == "table":
            for k, line in enumerate(leaf.lines):
                self.emit("table", leaf.first + k + (k > 0), leaf.first + k + (k > 0), "\t".join(cells(line)), row=k)
            return
        if leaf.kind == "code" and not leaf.mark:
            while leaf.lines and not leaf.lines[-1].strip():
                leaf.lines.pop()
                leaf.last -= 1
        self.emit(leaf.kind, leaf.first, leaf.last, "\n".join(leaf.lines).rstrip(" \t") if leaf.kind == "paragraph" else "\n".join(leaf.lines), info=leaf.info)

    def end_containers(self, keep: int) -> None:
        if keep < len(self.open):
            self.end_leaf()
            del self.open[keep:]

    def top(self) -> Container:
        return self.open[-1] if self.open else self.root

    def matched(self, line: str) -> tuple[int, str]:
        """How many open containers the line goes on with, and what is left of it."""
        for k, c in enumerate(self.open):
            bare = line.lstrip(" ")
            indent = len(line) - len(bare)
            if c.indent < 0:
                if indent > 3 or not bare.startswith(">"):
                    return k, line
                line = bare[1:].removeprefix(" ")
            elif not bare.strip():
                if c.empty:
                    return k, line
                line = ""
            elif indent >= c.indent:
                line = line[c.indent :]
            else:
                return k, line
        return len(self.open), line

    def begins_block(self, line: str) -> bool:
        """If a line that lacks containers' marks begins a block, and so is no lazy line."""
        bare = line.lstrip(" ")
        if len(line) - len(bare) > 3:
            return False
        return bool(bare.startswith(">") or ATX.match(bare) or FENCE.match(bare) or RULE.match(bare) or MARK.match(bare))

    def add(self, number: int, line: str) -> None:
        expanded = line[: len(line) - len(line.lstrip(" \t"))].expandtabs(4) + line.lstrip(" \t")
        keep, rest = self.matched(expanded)
        whole = keep == len(self.open)
        if whole and self.leaf and self.leaf.mark:
            self.in_fence(number, rest)
            return
        if not whole and self.leaf and self.leaf.kind == "paragraph" and rest.strip() and not self.begins_block(rest):
            self.leaf.lines.append(rest.strip(" "))
            self.leaf.last = number
            return
        self.end_containers(keep)
        rest = self.new_containers(rest)
        if rest.strip():
            for c in self.open:
                c.empty = False
        self.into_leaf(number, rest)

    def new_containers(self, rest: str) -> str:
        while True:
            bare = rest.lstrip(" ")
            indent = len(rest) - len(bare)
            if indent > 3 or not bare:
                return rest
            if bare.startswith(">"):
                self.end_leaf()
                self.top().series = None
                self.open.append(Container())
                rest = bare[1:].removeprefix(" ")
                continue
            mark = MARK.match(bare)
            under = self.leaf and self.leaf.kind == "paragraph" and UNDER.match(bare)
            if not mark or RULE.match(bare) or under:
                return rest
            body = bare[mark.end() :]
            ordered = mark[1] not in "-+*"
            if self.leaf and self.leaf.kind == "paragraph" and (not body.strip() or (ordered and int(mark[1][:-1]) != 1)):
                return rest
            body = body[: len(body) - len(body.lstrip(" \t"))].expandtabs(4) + body.lstrip(" \t")
            gap = len(body) - len(body.lstrip(" "))
            gap = gap if 1 <= gap <= 4 and body.strip() else 1
            self.end_leaf()
            parent, kind = self.top(), mark[1][-1]
            n = parent.series[1] + 1 if parent.series and parent.series[0] == kind else 1
            parent.series = (kind, n)
            self.open.append(Container(indent + len(mark[1]) + gap, n, ordered, empty=not body.strip()))
            rest = body[gap:]

    def in_fence(self, number: int, line: str) -> None:
        leaf = self.leaf
        leaf.last = number
        bare = line.strip(" \t")
        if len(line) - len(line.lstrip(" ")) <= 3 and bare and set(bare) == {leaf.mark[0]} and len(bare) >= len(leaf.mark):
            self.end_leaf()
        else:
            spare = min(leaf.indent, len(line) - len(line.lstrip(" ")))
            leaf.lines.append(line[spare:])

    def into_leaf(self, number: int, rest: str) -> None:
        bare = rest.lstrip(" ")
        indent = len(rest) - len(bare)
        leaf = self.leaf
        if not bare.strip():
            if leaf and leaf.kind == "code":
                leaf.lines.append(rest[4:])
                leaf.last = number
            else:
                self.end_leaf()
            return
        self.top().series = None
        if indent > 3 and not (leaf and leaf.kind == "paragraph"):
            if not leaf or leaf.kind != "code":
                self.end_leaf()
                self.leaf = leaf = Leaf("code", number, number)
            leaf.lines.append(rest[4:])
            leaf.last = number
            return
        if indent <= 3:
            if leaf and leaf.kind == "paragraph" and (under := UNDER.match(bare)):
                self.leaf = None
                self.emit("heading", leaf.first, number, "\n".join(leaf.lines).strip(" \t"), 1 if under[1][0] == "=" else 2)
                return
            if leaf and leaf.kind == "paragraph" and len(leaf.lines) == 1 and "|" in leaf.lines[0] + bare and DELIMITERS.match(bare) and len(cells(bare)) == len(cells(leaf.lines[0])):
                leaf.kind, leaf.last = "table", number
                return
            if found := ATX.match(bare):
                self.end_leaf()
                self.emit("heading", number, number, (found[2] or "").strip(), len(found[1]))
                return
            if found := FENCE.match(bare):
                self.end_leaf()
                self.leaf = Leaf("code", number, number, mark=found[1], indent=indent, info=found[2])
                return
            if RULE.match(bare):
                self.end_leaf()
                self.emit("rule", number, number, "")
                return
        if leaf and leaf.kind in ("paragraph", "table"):
            leaf.lines.append(bare)
            leaf.last = number
            return
        self.end_leaf()
        self.leaf = Leaf("paragraph", number, number, [bare])


def read(text: str | None) -> list[tuple]:
    """The blocks of a text, as COLUMNS says."""
    reader = Reader()
    lines = re.split(r"\r\n?|\n", text or "")
    for number, line in enumerate(lines, 1):
        if number < len(lines) or line:
            reader.add(number, line)
    reader.end_containers(0)
    reader.end_leaf()
    return reader.rows


def markdown_blocks(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The blocks of Markdown texts."""
    small_arrow_batches(documents.sparkSession)
    narrow = documents.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kinds = [pa.int64(), pa.string(), *[pa.int32()] * 4, pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column("__text").to_pylist()):
                rows = [(n, *r) for n, r in enumerate(read(t))]
                if rows:
                    owner = b.column("__key").take(pa.array([i] * len(rows)))
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([owner, *columns], names=["__key", "seq", *COLUMNS])

    kind = narrow.schema["__key"].dataType.simpleString()
    return narrow.mapInArrow(run, f"__key {kind}, {SCHEMA}").withColumnRenamed("__key", key)
