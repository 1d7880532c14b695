"""HTML as elements of a tree: nesting, lists and table grids, whatever end tags are missing.

A page is read once, with a stack of open elements. End tags that authors leave out are implied (a paragraph ends where a
block begins, an item where its sibling does, a cell, row or row group likewise); an end tag closes what is open up to its
element, but nothing outside the cell it stands in; one without an open element is nothing. All named and numeric character
references are resolved. Text between the edges of block elements is one element; inline marks do not cut it.

Elements: key, seq (dense, in page order), kind, level, depth, list_depth, table_no, row, col, row_span, col_span, tag,
content. kind is heading, list, term, cell, caption, preformatted, quote or paragraph, by the innermost such element that
is open; level is a heading's. depth counts the open block elements, list_depth the open lists. Tables are numbered in page order; cells
have their place in the grid, with the spans of cells before and above taken into account, and empty cells are rows too.
Other columns are null outside cells. White space runs become one space, but in preformatted text.

Pages are read where they lie, one row at a time; what follows (grids, counts, headings in force) is DataFrame work.

Defined results: null and empty pages give no rows; markup is never an error; what stands in script, style, head, nav,
footer, template and comments is no content; spans of no number are 1, over 1,000 columns or 65,534 rows these; rows
that repeat are read alike; elements may be nested to any depth.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import small_arrow_batches

HEADINGS = {f"h{k}": k for k in range(1, 7)}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head nav footer template".split())
LISTS = frozenset(("ul", "ol", "dl"))
CELLS = frozenset(("td", "th"))
GROUPS = frozenset(("thead", "tbody", "tfoot"))
BLOCKS = (
    frozenset("html body address article aside blockquote caption center dd details dialog div dt fieldset figcaption figure form".split())
    | frozenset("footer head header hgroup li main nav p pre section summary table title tr".split())
    | LISTS | CELLS | GROUPS | frozenset(HEADINGS)
)
KINDS = {
    **dict.fromkeys(HEADINGS, "heading"), **dict.fromkeys(CELLS, "cell"), "li": "list", "dd": "list", "dt": "term",
    "caption": "caption", "pre": "preformatted", "blockquote": "quote",
}
#: A start tag ends open elements of the first set, up to one of the second.
IMPLIED = {
    "li": ({"li"}, LISTS | {"table"}),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, LISTS | {"table"})),
    **dict.fromkeys(CELLS, (CELLS | {"caption"}, {"tr", "table"})),
    "tr": (CELLS | {"tr", "caption"}, {"table"}),
    **dict.fromkeys(GROUPS, (CELLS | GROUPS | {"tr", "caption"}, {"table"})),
    "option": ({"option"}, {"select"}),
}
SCOPE = CELLS | {"table", "caption", "button"}  # a paragraph in one of these ends there at the latest
COLUMNS = ("kind", "level", "depth", "list_depth", "table_no", "row", "col", "row_span", "col_span", "tag", "content")
SCHEMA = "seq long, kind string, level int, depth int, list_depth int, table_no int, row int, col int, row_span int, col_span int, tag string, content string"


class Grid:
    """Where a table's cells lie."""

    def __init__(self, number: int):
        self.number, self.row, self.col = number, -1, 0
        self.taken: dict[int, int] = {}  # by column, the first row below what reaches down from above

    def next_row(self) -> None:
        self.row, self.col = self.row + 1, 0

    def place(self, rows: int, columns: int) -> tuple[int, int, int, int, int]:
        if self.row < 0:
            self.next_row()
        while self.taken.get(self.col, 0) > self.row:
            self.col += 1
        at = self.col
        for c in range(at, at + columns):
            self.taken[c] = self.row + rows
        self.col += columns
        return self.number, self.row, at, rows, columns


def span(value: str | None, most: int) -> int:
    found = re.match(r"\s*(\d{1,9})", value or "")
    return max(1, min(most, int(found[1]))) if found else 1


class Reader(HTMLParser):
    """Collects the elements of one page in `rows`."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple | None]] = []  # tag, and of a cell its place
        self.count: Counter = Counter()  # of open elements by tag
        self.kinds: list[str] = []  # the open elements that name a kind
        self.cells: list[tuple | None] = []  # the places of open cells
        self.blocks: list[str] = []
        self.depth = self.lists = self.hidden = self.tables = 0
        self.grids: list[Grid] = []
        self.text: list[str] = []
        self.rows: list[tuple] = []
        self.filled = False  # if the innermost cell has had text

    def flush(self, cell_ends: bool = False) -> None:
        """Makes a row of the text so far, if there is any; of an empty cell at its end, an empty row."""
        joined, self.text = "".join(self.text), []
        if self.hidden or not (joined or cell_ends):
            return
        tag = self.kinds[-1] if self.kinds else ""
        kind = KINDS.get(tag, "paragraph")
        content = joined.strip("\n") if kind == "preformatted" else " ".join(joined.split())
        if not content.strip() and not (cell_ends and kind == "cell" and not self.filled):
            return
        place = self.cells[-1] if self.cells else None
        self.filled = True
        self.rows.append((kind, HEADINGS.get(tag), self.depth, self.lists, *(place or (None,) * 5), self.blocks[-1] if self.blocks else "", content))

    def push(self, tag: str, place: tuple | None = None) -> None:
        self.stack.append((tag, place))
        self.count[tag] += 1
        self.depth += tag in BLOCKS
        self.lists += tag in LISTS
        self.hidden += tag in HIDDEN
        if tag in KINDS:
            self.kinds.append(tag)
        if tag in CELLS:
            self.cells.append(place)
        if tag in BLOCKS:
            self.blocks.append(tag)

    def pop(self) -> None:
        tag, _ = self.stack[-1]
        if tag in BLOCKS:
            self.flush(tag in CELLS)
        if tag in CELLS:
            self.filled = True  # what follows in a cell around this one comes after its table
        self.stack.pop()
        for held, tags in ((self.kinds, KINDS), (self.cells, CELLS), (self.blocks, BLOCKS)):
            if tag in tags:
                held.pop()
        self.count[tag] -= 1
        self.depth -= tag in BLOCKS
        self.lists -= tag in LISTS
        self.hidden -= tag in HIDDEN
        if tag == "table" and self.grids:
            self.grids.pop()

    def close(self) -> None:
        super().close()
        while self.stack:
            self.pop()
        self.flush()

    def end_to(self, tags: frozenset | set, barrier: frozenset | set) -> None:
        """Closes the outermost open element of `tags` inside the innermost of `barrier`, with all in it."""
        if not any(self.count[t] for t in tags):
            return
        last = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in barrier:
                break
            if self.stack[i][0] in tags:
                last = i
        while last is not None and len(self.stack) > last:
            self.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self.text.append("\n" if self.count["pre"] else " ")
            if tag == "hr":
                self.end_to({"p"}, SCOPE)
                self.flush()
            return
        if tag in BLOCKS:
            self.end_to({"p"}, SCOPE)
            if tag in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
                self.pop()
        if tag in IMPLIED:
            self.end_to(*IMPLIED[tag])
        if tag in BLOCKS:
            self.flush()
        place = None
        if tag == "table":
            self.tables += 1
            self.grids.append(Grid(self.tables - 1))
        elif tag == "tr" and self.grids:
            self.grids[-1].next_row()
        elif tag in CELLS and self.grids:
            found = dict(attrs)
            place = self.grids[-1].place(span(found.get("rowspan"), 65_534), span(found.get("colspan"), 1_000))
            self.filled = False
        self.push(tag, place)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag(tag, [])
        if not self.count[tag]:
            return
        barrier = frozenset() if tag in ("table", "body", "html") else {"table"} if tag in CELLS | GROUPS | {"tr", "caption"} else CELLS | {"table"}
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i][0] in barrier:
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)


def read(page: str | None) -> list[tuple]:
    """The elements of a page, as COLUMNS says."""
    reader = Reader()
    reader.feed(page or "")
    reader.close()
    return reader.rows


def html_tree(documents: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """The elements of pages."""
    small_arrow_batches(documents.sparkSession)
    narrow = documents.select(F.col(key).alias("__key"), F.col(html).alias("__html"))
    fields = [pa.int64(), pa.string(), *[pa.int32()] * 8, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, page in enumerate(b.column("__html").to_pylist()):
                rows = [(n, *r) for n, r in enumerate(read(page))]
                if rows:
                    owner = b.column("__key").take(pa.array([i] * len(rows)))
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields, strict=True)]
                    yield pa.RecordBatch.from_arrays([owner, *columns], names=["__key", "seq", *COLUMNS])

    kind = narrow.schema["__key"].dataType.simpleString()
    return narrow.mapInArrow(run, f"__key {kind}, {SCHEMA}").withColumnRenamed("__key", key)


def table_shapes(elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, table_no, rows, columns, cells and text (cells in page order, joined by a space) of each table."""
    cells = elements.where("table_no is not null")
    reach = lambda at, size: F.max(F.col(at) + F.col(size)).cast("int")
    ordered = F.sort_array(F.collect_list(F.struct("seq", "content")))
    return cells.groupBy(key, "table_no").agg(
        reach("row", "row_span").alias("rows"),
        reach("col", "col_span").alias("columns"),
        F.count_distinct("row", "col").alias("cells"),
        F.array_join(F.filter(F.transform(ordered, lambda c: c["content"]), lambda c: c != ""), " ").alias("text"),
    )
