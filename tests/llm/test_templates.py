"""Line dedup against a plain version in Python."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from leafmill.llm import templates


def slow(docs, min_docs=3, leading=3, similarity=0.7, min_tokens=3, keep_first=True):
    """docs: (doc_id, text) pairs; distinct documents, in the order of ids with nulls last. Gives the texts."""
    held = {}
    for d, t in docs:
        held[d, t] = t
    lines, in_leaf = defaultdict(set), Counter()
    cut = lambda x: [w for w in re.split("[ \t\r]", x) if w]
    place = lambda w: (len(w), *("<*>" if re.search("[0-9]", t) else t for t in w[:leading]))
    for key, t in held.items():
        for x in set(t.split("\n")) if t is not None else ():
            if len(cut(x)) >= min_tokens:
                lines[x].add(key)
                in_leaf[place(cut(x))] += 1
    held_at = Counter()
    some = [x for x in lines if in_leaf[place(cut(x))] >= min_docs]
    for x in some:
        for i, w in enumerate(cut(x)):
            held_at[place(cut(x)), i, w] += len(lines[x])
    of, holders = {}, defaultdict(set)
    for x in some:
        leaf = place(cut(x))
        kept = tuple((i, w) for i, w in enumerate(cut(x)) if held_at[leaf, i, w] >= min_docs)
        if len(kept) >= similarity * len(cut(x)):
            of[x] = (leaf, kept)
            holders[of[x]] |= lines[x]
    order = lambda k: (k[0] is None, k[0] or 0)
    first = {t: min(h, key=order) for t, h in holders.items() if len(h) >= min_docs}
    gone = lambda x, key: x in of and of[x] in first and not (keep_first and first[of[x]] == key)
    return [None if t is None else "\n".join(x for x in t.split("\n") if not gone(x, (d, t))) for d, t in docs]


def compare(spark, docs, **k):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["text"] is None) for r in templates.dedup_lines(df, **k).collect()))
    expected = sorted(((d is None, d or 0, t or "", t is None) for (d, _), t in zip(docs, slow(docs, **k), strict=True)))
    assert got == expected


def test_templates_generalise(spark):
    docs = [(i, f"Own line number {i} of {i * 7} words\nJob {i} finished in {i * 3} seconds for user u{i}\nown {'abc' * i} text {i} z{i}") for i in range(12)]
    docs += [(20, "Job 5 finished in 9 seconds for user x"), (21, "Job 5 failed in 9 hours of work today")]
    compare(spark, docs, similarity=0.5)
    texts = {r["doc_id"]: r["text"] for r in templates.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), similarity=0.5).collect()}
    assert "finished" in texts[0] and "finished" not in texts[5] and texts[20] == "" and texts[21]


def test_random_tables(spark):
    random.seed(11)
    pool = ["All rights reserved here", "a b", "page 1 of 9 now", "page 2 of 9 now", "page 3 of 8 now", "", "one two three four", "one two three five", "x\ty z\r", "Read more about it"]
    docs = [(i if i % 9 else None, "\n".join(random.choice(pool) if random.random() < 0.6 else " ".join(random.choices("abcdefgh", k=random.randint(1, 6))) for _ in range(random.randint(1, 8)))) for i in range(1, 80)]
    compare(spark, docs)
    compare(spark, docs, keep_first=False, min_docs=2)


def test_repeated_rows_are_one_document(spark, tmp_path):
    docs = [(1, "alpha beta gamma X9"), (2, "alpha beta gamma Y9"), (3, "alpha beta gamma Z9")]
    docs += [docs[0], docs[0], (4, "alpha beta gamma X9"), (1, "another text of document one"), (1, None), (1, None), (None, "alpha beta gamma X9"), (None, "alpha beta gamma X9")]
    compare(spark, docs)
    compare(spark, docs, min_docs=2)
    path = str(tmp_path / "documents.parquet")
    named = [(d, t) for d, t in docs if d is not None and t is not None and (d, t) != docs[6]]
    spark.createDataFrame(named, "doc_id long, text string").coalesce(1).write.parquet(path)
    by_sql = duckdb.sql(templates.SQL.replace("documents ", f"read_parquet('{path}/*.parquet') ")).fetchall()
    got = [tuple(r) for r in templates.query(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(by_sql) and sum(r[2] for r in got) > 0


def test_hot_keys_are_joined_alike(spark, monkeypatch):
    random.seed(3)
    docs = [(i, "\n".join(random.choice(["the same line of all", "page 1 of 9 now", f"own line {i} here", "one two three four five"]) for _ in range(4))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plain = sorted(map(tuple, templates.dedup_lines(df, share=0.5).collect()))
    monkeypatch.setattr(templates, "COLD", 1)
    compare(spark, docs)
    assert sorted(map(tuple, templates.dedup_lines(df, share=0.5).collect())) == plain


def test_columns_of_any_name(spark):
    same = "the very same line"
    df = spark.createDataFrame([(i, same, "u", "p", 1) for i in range(4)], ["doc_id", "text", "meta.url", "parts", "__lt_id"])
    out = templates.dedup_lines(df)
    assert out.columns == [*df.columns, "__lt_lines", "__lt_dropped"] and sorted(r["text"] for r in out.collect()) == ["", "", "", same]


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in templates.query(spark, sf).collect()}
    for (d, t), left in zip(docs, slow(docs), strict=True):
        assert got[d]["text"] == left and got[d]["n_lines"] == len(t.split("\n"))
        assert got[d]["n_dropped"] == len(t.split("\n")) - (len(left.split("\n")) if left or not got[d]["n_dropped"] else got[d]["n_lines"] - got[d]["n_dropped"])


def test_shuffled_and_broadcast_leaves_agree(spark):
    df = spark.createDataFrame([(i, f"the same line here\nown {i}") for i in range(6)], "doc_id long, text string")
    for n in (0, 100):
        lines, recurring = templates.recurring_lines(df, broadcast_leaves=n)
        assert lines.count() == 1 and recurring.first()["docs"] == 6


def test_odd_rows(spark):
    same = "the very same line"
    rows = [(1, None, 1, "a"), (2, "", 2, "b"), (3, same, 3, "c"), (3, same, 3, "c"), (4, same, 4, "d"), (5, same + "\n" + "long " * 50_000, 5, "e"), (None, same, 6, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, line int, leaf string")
    out = templates.dedup_lines(df)
    got = sorted((r["leaf"], r["line"], r["text"] if r["text"] is None else r["text"][:20]) for r in out.collect())
    assert got == [("a", 1, None), ("b", 2, ""), ("c", 3, same), ("c", 3, same), ("d", 4, ""), ("e", 5, ("long " * 4)), ("f", 6, "")]
    assert templates.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [100, 20_000])
def test_variable_fields_stay_wildcards_at_every_size(spark, n):
    random.seed(n)
    rows = [(i, f"Downloaded from the public archive mirror at {random.randrange(1000)} by user{random.randrange(1000)}\nown text {i}") for i in range(n)]
    left = templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), share=0.5)
    assert left.where("text like 'Downloaded%'").select("doc_id").collect() == [(0,)]
    assert left.where("text not like '%own text%'").count() == 0


def test_lines_join_a_recurring_line_they_differ_from_in_a_field(spark):
    same = "Copyright of this page is held by its own authors".split(" ")
    rows = [(i, " ".join(same)) for i in range(50)] + [(100 + k, " ".join([*same[:k], "other", *same[k + 1 :]])) for k in range(3, 10)] + [(200, "Copyright of this thing was kept for the many heirs")]
    left = templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), share=0.5)
    assert {r["doc_id"] for r in left.where("text <> ''").collect()} == {0, 200}


def slow_relative(docs, share=0.5, min_docs=3, leading=3, similarity=0.7, min_tokens=3):
    """The texts that are left, by the rule with relative constants; every line is compared with every pattern of its leaf."""
    held, in_leaf = defaultdict(set), Counter()
    cut = lambda x: [w for w in re.split("[ \t\r]", x) if w]
    place = lambda w: (len(w), *("<*>" if re.search("[0-9]", t) else t for t in w[:leading]))
    for d, t in docs:
        for x in set(t.split("\n")):
            if len(cut(x)) >= min_tokens:
                held[x].add(d)
                in_leaf[place(cut(x))] += 1
    some = [x for x in held if in_leaf[place(cut(x))] >= min_docs]
    held_at = Counter()
    for x in some:
        for i, w in enumerate(cut(x)):
            held_at[place(cut(x)), i, w] += len(held[x])
    of, total = {}, Counter()
    for x in some:
        leaf, n = place(cut(x)), len(cut(x))
        most = sorted(((held_at[leaf, i, w], i, w) for i, w in enumerate(cut(x)) if held_at[leaf, i, w] >= min_docs), reverse=True)
        wanted = -int(-(similarity * n - 1e-9) // 1)
        if len(most) >= wanted:
            of[x] = (leaf, tuple(sorted((i, w) for h, i, w in most if h >= share * most[wanted - 1][0])))
            total[of[x]] += len(held[x])
    here = {x: t for x, t in of.items() if total[t] >= min_docs}
    patterns = defaultdict(set)
    for x, t in here.items():
        patterns[t[0]].add((t, tuple(dict(t[1]).get(i) for i in range(t[0][0]))))
        if len(held[x]) >= min_docs:
            patterns[t[0]].add((t, tuple(cut(x))))
    joins = dict(here)
    for x in some:
        if x not in here:
            alike = [(sum(a == b for a, b in zip(cut(x), p, strict=True)), t) for t, p in patterns[place(cut(x))]]
            alike = [(n, t) for n, t in alike if n >= similarity * len(cut(x)) - 1e-9]
            if alike:
                joins[x] = alike
    return joins, held, here


def lines_left(spark, docs, **k):
    left = templates.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), share=0.5, keep_first=False, **k)
    return {r["doc_id"]: r["text"] for r in left.collect()}


def test_every_line_similar_to_a_recurring_pattern_goes(spark):
    random.seed(4)
    pool = [f"w{chr(97 + i)}" for i in range(12)]
    base = [["Same", "three", "words", *random.choices(pool, k=9)] for _ in range(60)]
    docs, n = [], 0
    for line in base:
        for _ in range(random.randint(3, 9)):
            docs.append((n := n + 1, " ".join(line)))
    planted = []
    for _ in range(200):
        line = list(random.choice(base))
        for i in random.sample(range(3, 12), 3):
            line[i] = random.choice([w for w in pool if w != line[i]])
        docs.append((n := n + 1, " ".join(line)))
        planted.append(n)
    left = lines_left(spark, docs)
    assert [d for d in planted if left[d]] == []


def test_an_unrelated_template_of_many_documents_hides_none(spark):
    shared = "the page was written by its many own authors here".split(" ")
    docs = [(i, " ".join(shared)) for i in range(5)]
    docs.append((10, " ".join([*shared[:3], "w", "x", "y", *shared[6:]])))
    docs += [(20 + i, " ".join([*shared[:3], "a", "the", "b", "many", "c", "d", "e"])) for i in range(10)]
    assert set(lines_left(spark, docs).values()) == {""}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_relative_rule_on_random_leaves(spark, seed):
    random.seed(seed)
    docs = []
    for i in range(150):
        lines = []
        for _ in range(random.randint(1, 4)):
            size = random.choice([4, 6, 9])
            lines.append(" ".join(["go", random.choice(["x", "1"]), "on", *(random.choices("abcde", weights=[8, 4, 2, 1, 1], k=size - 3))]))
        docs.append((i, "\n".join(lines)))
    joins, held, here = slow_relative(docs)
    got, _ = templates.recurring_lines(spark.createDataFrame(docs, "doc_id long, text string"), share=0.5)
    marked = {r["lh"] for r in got.collect()}
    hashed = {r["x"]: r["h"] for r in spark.createDataFrame([(x,) for x in held], "x string").selectExpr("x", "xxhash64(x) as h").collect()}
    assert marked == {hashed[x] for x in joins} and len(here) < len(joins)


def test_names_of_count_columns(spark):
    same = "the very same line"
    df = spark.createDataFrame([(i, same, 1, 2) for i in range(4)], ["doc_id", "text", "__lt_lines", "__lt_dropped"])
    with pytest.raises(ValueError):
        templates.dedup_lines(df)
    assert templates.dedup_lines(df, counts=None).columns == df.columns
    assert templates.dedup_lines(df, counts=("a", "b")).where("b = 1").count() == 3
