"""Markdown blocks: cases of the grammar, and random trees written and read back."""

import random

import pytest

from leafmill.sources import markdown


def short(text, *names):
    at = [markdown.COLUMNS.index(n) for n in names or ("kind", "content")]
    return [tuple(r[i] for i in at) for r in markdown.read(text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("", []),
        (None, []),
        (" \n\t\n", []),
        ("# A #\n## B\n#\n#no", [("heading", "A"), ("heading", "B"), ("heading", ""), ("paragraph", "#no")]),
        ("Title\n=====\ntwo\nlines\n---", [("heading", "Title"), ("heading", "two\nlines")]),
        ("a\n b\n      c\n\nd", [("paragraph", "a\nb\nc"), ("paragraph", "d")]),
        ("```py\n# no\n\n ```x\n```\nt", [("code", "# no\n\n ```x"), ("paragraph", "t")]),
        ("~~~\nnever ends", [("code", "never ends")]),
        ("    code\n\n     more\n\nt", [("code", "code\n\n more"), ("paragraph", "t")]),
        ("a\n***\n- - -\n___", [("paragraph", "a"), ("rule", ""), ("rule", ""), ("rule", "")]),
        ("> q\nlazy\n\nout", [("paragraph", "q\nlazy"), ("paragraph", "out")]),
        ("> q\n# h", [("paragraph", "q"), ("heading", "h")]),
        ("| a | b |\n|---|:-:|\n| 1 | x\\|y |\n\nt", [("table", "a\tb"), ("table", "1\tx|y"), ("paragraph", "t")]),
        ("a | b\n--- | --- | ---", [("paragraph", "a | b\n--- | --- | ---")]),
        ("text\n2. two\n-", [("heading", "text\n2. two")]),
        ("text\n1. one", [("paragraph", "text"), ("paragraph", "one")]),
        ("a\r\nb\rc", [("paragraph", "a\nb\nc")]),
    ],
)
def test_blocks(text, expected):
    assert short(text) == expected


def test_containers():
    text = "- a\n  - b\n\n    c\n  - d\n- e\n  > f\n  > 1. g\n  >    h\n\n1) x\n2) y\n\npara\n- z"
    assert short(text, "content", "list_depth", "quote_depth", "item", "ordered") == [
        ("a", 1, 0, 1, False), ("b", 2, 0, 1, False), ("c", 2, 0, 1, False), ("d", 2, 0, 2, False), ("e", 1, 0, 2, False), ("f", 1, 1, 2, False),
        ("g\nh", 2, 1, 1, True), ("x", 1, 0, 1, True), ("y", 1, 0, 2, True), ("para", 0, 0, None, None), ("z", 1, 0, 1, False),
    ]
    assert short("> > deep\n> less\n\n> again", "content", "quote_depth") == [("deep\nless", 2), ("again", 1)]
    assert short("-\n\n  out", "kind", "list_depth") == [("paragraph", 0)]
    assert short("- ```\n  in\nout", "kind", "content", "list_depth") == [("code", "in", 1), ("paragraph", "out", 0)]


def test_spans():
    text = "# a\n\nb\nc\n\n| x |\n|---|\n| y |\n\n```\nz\n```\n> q\nlazy"
    assert short(text, "kind", "first_line", "last_line") == [("heading", 1, 1), ("paragraph", 3, 4), ("table", 6, 6), ("table", 8, 8), ("code", 10, 12), ("paragraph", 13, 14)]


def composed(rng, depth=0):
    """(lines, blocks): random blocks written as Markdown; blocks are (kind, level, quotes, lists, content)."""
    word = lambda: rng.choice(["alpha", "beta *b*", "gamma `c`", "d|e", "x > y", "1.5", "#tag"])
    lines, blocks, before = [], [], ""
    for _ in range(rng.randint(1, 4)):
        choice = rng.choice(["p", "atx", "setext", "fence", "rule", *(["quote", "list"] if depth < 4 else [])])
        if choice == before == "list":
            choice = "p"
        before = choice
        if lines:
            lines.append("")
        text = "w " + word()
        if choice == "p":
            more = ["w " + word() for _ in range(rng.randint(0, 2))]
            lines += [text, *more]
            blocks.append(("paragraph", None, 0, 0, "\n".join([text, *more])))
        elif choice == "atx":
            level = rng.randint(1, 6)
            lines.append("#" * level + " " + text + rng.choice(["", " ##"]))
            blocks.append(("heading", level, 0, 0, text))
        elif choice == "setext":
            lines += [text, rng.choice(["=", "==="])]
            blocks.append(("heading", 1, 0, 0, text))
        elif choice == "fence":
            body = [rng.choice(["# no", "> no", "- no", "", "    x"]) for _ in range(rng.randint(0, 3))]
            mark = rng.choice(["```", "~~~~"])
            lines += [mark, *body, mark]
            blocks.append(("code", None, 0, 0, "\n".join(body)))
        elif choice == "rule":
            lines.append(rng.choice(["***", "* * *", "___"]))
            blocks.append(("rule", None, 0, 0, ""))
        elif choice == "quote":
            inner, found = composed(rng, depth + 1)
            lines += [("> " + x) if x else ">" for x in inner]
            blocks += [(k, n, q + 1, i, c) for k, n, q, i, c in found]
        else:
            mark = rng.choice(["-", "+", "7.", "12)"])
            for _ in range(rng.randint(1, 3)):
                inner, found = composed(rng, depth + 1)
                head = mark + " " * rng.randint(1, 3)
                lines += [head + inner[0], *[" " * len(head) + x if x else "" for x in inner[1:]], ""]
                blocks += [(k, n, q, i + 1, c) for k, n, q, i, c in found]
            lines.pop()
    return lines, blocks


@pytest.mark.parametrize("seed", range(300))
def test_random_trees_come_back(seed):
    lines, blocks = composed(random.Random(seed))
    assert short("\n".join(lines), "kind", "level", "quote_depth", "list_depth", "content") == blocks


def test_frame(spark):
    df = spark.createDataFrame([("a", "# h\n\np", 1), ("b", None, 2), ("a", "# h\n\np", 1), ("c", "w " * 100_000, 1)], "path string, text string, seq int")
    got = markdown.markdown_blocks(df, "path")
    assert got.columns == ["path", "seq", *markdown.COLUMNS] and got.count() == 5 and markdown.markdown_blocks(df.limit(0), "path").count() == 0
