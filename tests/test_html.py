"""HTML trees: broken markup, references, grids; and all pages against another reader."""

import re
from html import unescape

import pytest

from leafmill.sources import html


def short(page, *names):
    at = [html.COLUMNS.index(n) for n in names or ("kind", "content")]
    return [tuple(r[i] for i in at) for r in html.read(page)]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("", []),
        (None, []),
        ("just text", [("paragraph", "just text")]),
        ("<p>one<p>two</p>three", [("paragraph", "one"), ("paragraph", "two"), ("paragraph", "three")]),
        ("<p>a <b>b</i> c</b> d</p>", [("paragraph", "a b c d")]),
        ("caf&eacute; &#8217;&mdash;&#x41; &amp;lt; &nosuch; &copy", [("paragraph", "café ’—A &lt; &nosuch; ©")]),
        ("a<!-- <p>no</p> -->b<script>if (a<b) x('</p>')</script>c", [("paragraph", "abc")]),
        ("<h2>T</h2>x<h3>U<h4>V", [("heading", "T"), ("paragraph", "x"), ("heading", "U"), ("heading", "V")]),
        ("<ul><li>a<li>b</ul>", [("list", "a"), ("list", "b")]),
        ("</p></div></td>x</p>", [("paragraph", "x")]),
        ("<pre>\n a\n  b<br>c</pre>", [("preformatted", " a\n  b\nc")]),
        ("<blockquote><p>q</p>r</blockquote>", [("quote", "q"), ("quote", "r")]),
        ("<dl><dt>t<dd>d<dt>u</dl>", [("term", "t"), ("list", "d"), ("term", "u")]),
        ("<nav>n</nav><head><title>t</title></head>b<footer>f", [("paragraph", "b")]),
        ("a<br>b<hr>c", [("paragraph", "a b"), ("paragraph", "c")]),
        ("<div/>x<p/>y", [("paragraph", "x"), ("paragraph", "y")]),
        ("a < b & c <", [("paragraph", "a < b & c <")]),
    ],
)
def test_text_of_markup(page, expected):
    assert short(page) == expected


def test_lists_nest():
    page = "<ul><li>a<ol><li>b<li>c<ul><li>d</ul></ol>e<li>f</ul>g"
    assert short(page, "content", "list_depth") == [("a", 1), ("b", 2), ("c", 2), ("d", 3), ("e", 1), ("f", 1), ("g", 0)]
    assert short("<div><section><p>x", "depth", "tag") == [(3, "p")]


def test_cells_have_places():
    page = "<table><caption>C<tr><th>1<th>2<tr><td rowspan=2>a<td>b<tr><td>c<td colspan='2'>d<tr><td><td>e</table>after"
    got = short(page, "content", "row", "col", "row_span", "col_span")
    assert got == [
        ("C", None, None, None, None), ("1", 0, 0, 1, 1), ("2", 0, 1, 1, 1), ("a", 1, 0, 2, 1), ("b", 1, 1, 1, 1), ("c", 2, 1, 1, 1),
        ("d", 2, 2, 1, 2), ("", 3, 0, 1, 1), ("e", 3, 1, 1, 1), ("after", None, None, None, None),
    ]


def test_tables_nest_and_cells_hold_blocks():
    page = "<table><tr><td><p>x<table><td>in</p>ner<td>2</table>y<td>z</table><table><tr><td><h1>h</h1></table>"
    assert short(page, "kind", "content", "table_no", "row", "col") == [
        ("cell", "x", 0, 0, 0), ("cell", "inner", 1, 0, 0), ("cell", "2", 1, 0, 1), ("cell", "y", 0, 0, 0), ("cell", "z", 0, 0, 1), ("heading", "h", 2, 0, 0),
    ]
    assert short("<td>alone</td><tr>x", "content", "table_no") == [("alone", None), ("x", None)]
    assert short("<table><tr><td rowspan=0 colspan=junk>a<td colspan=99999>b", "row_span", "col_span") == [(1, 1), (1, 1000)]


def test_deep_nesting_is_linear():
    rows = html.read("<div>" * 50_000 + "x" + "</div>" * 50_000 + "<p>y")
    assert [(r[2], r[-1]) for r in rows] == [(50_000, "x"), (1, "y")]


def plain_reader(page):
    """Another way for pages without tables: cut at block tags, with a list of what is open."""
    page = re.sub(r"(?is)<!--.*?-->|<(script|style|head|nav|footer)\b.*?</\1\s*>", "", page)
    out, open_tags, text = [], [], ""

    def done():
        nonlocal text
        said, text = " ".join(unescape(text).split()), ""
        if said:
            heading = next((t for t in reversed(open_tags) if re.fullmatch("h[1-6]", t)), None)
            out.append(("heading" if heading else "list" if "li" in open_tags else "paragraph", len(open_tags), said))

    for piece in re.split(r"(<[^>]*>)", page):
        tag = re.fullmatch(r"<(/?)([a-zA-Z0-9]+)[^>]*>", piece)
        if not tag:
            text += piece if not piece.startswith("<!") else ""
            continue
        name = tag[2].lower()
        if name == "br":
            text += " "
        elif name in html.BLOCKS:
            done()
            if tag[1] and name in open_tags:
                del open_tags[len(open_tags) - 1 - open_tags[::-1].index(name) :]
            elif not tag[1]:
                if "p" in open_tags:
                    del open_tags[open_tags.index("p") :]
                open_tags.append(name)
    done()
    return out


def test_all_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {}
    for r in html.html_tree(pages, "page_id").orderBy("page_id", "seq").collect():
        got.setdefault(r["page_id"], []).append((r["kind"], r["depth"], r["content"]))
    for r in pages.collect():
        assert got.get(r["page_id"], []) == plain_reader(r["html"])


def test_tables_of_a_frame(spark):
    rows = [("a", "<table><tr><td>1<td>2<tr><td colspan=2>3</table>", 1), ("b", None, 1), ("c", "", 1), ("a", "<table><tr><td>1<td>2<tr><td colspan=2>3</table>", 1)]
    df = spark.createDataFrame(rows, "url string, html string, seq int")
    found = html.html_tree(df, "url")
    assert found.columns == ["url", "seq", *html.COLUMNS] and found.count() == 6 and html.html_tree(df.limit(0), "url").count() == 0
    shapes = html.table_shapes(html.html_tree(df.limit(1), "url"), "url").collect()
    assert [tuple(r) for r in shapes] == [("a", 0, 2, 2, 3, "1 2 3")]
