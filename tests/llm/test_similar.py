"""Similarity of shingle sets against all pairs, in hot groups, from just the limit, and over the table."""

import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import simhash, similar


def shingles(text, width=5):
    cut = (text or "").encode().lower().split()
    return {tuple(cut[i : i + width]) for i in range(max(1, len(cut) - width + 1))} if cut else set()


def classes(texts, similarity=0.8):
    """The least index of each text's class, by all pairs (those that share a shingle; empty texts are one class)."""
    sets, parent, holders = [shingles(t) for t in texts], list(range(len(texts))), {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(i, j):
        x, y = find(i), find(j)
        parent[max(x, y)] = min(x, y)

    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders.get(x, ()):
                shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if n >= similarity * (len(s) + len(sets[j]) - n) - 1e-9:
                join(i, j)
        for x in s or {"none"}:
            holders.setdefault(x, []).append(i)
        if not s:
            join(i, holders["none"][0])
    return [find(i) for i in range(len(texts))]


def compare(spark, texts, **k):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root, first = {r["doc_id"]: r["root"] for r in similar.similar_classes(docs, **k).collect()}, {}
    got = [first.setdefault(root[i], i) for i in range(len(texts))]
    assert got == classes(texts)
    return got


def test_shingles_of_a_batch():
    texts = [None, "", " \t", "One", "a b c d", "A  b\nC d E", "x y " * 3000, "Ünï CÖDE über x y z\u00a0w", "a\x1cb c d e f", "one\x0btwo\x0cthree\rfour five six"]
    hashes, at = similar.shingle_hashes(pa.array(texts), 5)
    sets = [set(hashes[i:j].tolist()) for i, j in zip(at[:-1], at[1:], strict=True)]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert [int(n) for n in np.diff(at)] == [max(1, len(t.encode().split()) - 4) if (t or "").strip() else 0 for t in texts]
    again, _ = similar.shingle_hashes(pa.array(["z", "a b c d e f"]).slice(1), 5)
    assert set(again.tolist()) >= sets[5] and len(set(again.tolist())) == 2


def test_random_edits_equal_all_pairs(spark, monkeypatch):
    random.seed(12)
    word = lambda: "".join(random.choices("abcdefgh", k=4))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(random.choice([3, 6, 12, 40, 300]))]
        texts.append(" ".join(base).upper())
        for _ in range(random.randint(0, 5)):
            t = list(base)
            for _ in range(random.randint(0, 1 + len(base) // 25)):
                t[random.randrange(len(t)) :][:1] = [word()]
                k = random.randrange(len(t))
                t[k : k + random.randint(0, 2)] = [word()] * random.randint(0, 2)
            texts.append("  ".join(t))
    texts += [None, "", "  ", "w " * 5000, "w " * 60]
    got = compare(spark, texts)
    assert 60 < len(set(got)) < len(texts)
    monkeypatch.setattr(similar, "LIMIT", 2)
    monkeypatch.setattr(similar, "BLOCK", 3)
    assert compare(spark, texts) == got


@pytest.mark.parametrize(("common", "n"), [(300, 1200), (350, 1000)])
def test_hot_passage_of_dissimilar_documents(spark, common, n):
    random.seed(common)
    passage = [f"p{i}" for i in range(common)]
    texts = [" ".join([*passage, *(f"d{i}x{k}" for k in range(400 - common))]) for i in range(n)]
    near = [t.split(" ") for t in texts[:120]]
    for k, t in enumerate(near):
        t[-2 - k % 8 :] = [f"e{k}x{j}" for j in range(3)]  # similarity 0.95 and more
    got = compare(spark, [*texts, *map(" ".join, near)])
    assert got == [*range(n), *range(120)]


def test_large_group_of_near_copies(spark):
    random.seed(13)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(400):
        t = list(base)
        t[random.randrange(200)] = f"own{i}"
        texts.append(" ".join(t))
    compare(spark, texts + [f"short text number {i} of few words" for i in range(60)])


def test_similarity_from_just_the_limit(spark):
    words = lambda i, n: [f"d{i}x{k}" for k in range(n)]
    edited = lambda t, n: [*t[: len(t) - n], *(w + "y" for w in t[len(t) - n :])]
    seen = set()
    for a, b, n in [(8, 9, 0), (304, 304, 33), (304, 304, 30), (304, 304, 34), (304, 304, 40), (44, 44, 4), (44, 44, 5)]:
        pairs = [(words(i, a), edited(words(i, b), n)) for i in range(30)]
        x, y = map(shingles, map(" ".join, pairs[0]))
        j = len(x & y) / len(x | y)
        got = compare(spark, [" ".join(t) for pair in pairs for t in pair])
        assert sum(got[2 * i] == got[2 * i + 1] for i in range(30)) == (30 if j >= 0.8 else 0)
        seen.add(j >= 0.8)
    assert seen == {True, False}


def test_the_table_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    got = compare(spark, [r["text"] for r in docs])
    assert len(set(got)) < len(got)


def test_rows_that_stay(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base, "a", 1), (3, base + " more", "b", 2), (3, base + " more", "b", 2), (9, None, "c", 3), (8, "", "d", 4), (None, base, "e", 5), (7, "a text of its own", "f", 6), (None, "alone", "g", 7), (None, "alone", "g", 8)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "meta.url", "__rows"])
    kept = similar.keep_one_of_similar(docs)
    assert kept.columns == docs.columns
    assert sorted((r["meta.url"], r["__rows"]) for r in kept.collect()) == [("b", 2), ("d", 4), ("f", 6), ("g", 7)]
    assert similar.keep_one_of_similar(docs.limit(0)).count() == 0
    named = spark.createDataFrame([("x", base), ("b", base)], "doc_id string, text string")
    assert [r["doc_id"] for r in similar.keep_one_of_similar(named).collect()] == ["b"]


def test_near_fingerprints_are_found_by_the_planned_pigeonhole(spark, monkeypatch):
    random.seed(14)
    texts = []
    for i in range(150):
        t = [f"t{i}w{k}" for k in range(400)]
        texts += [" ".join(t), " ".join([*t[:-1], f"other{i}"])]
    seen, plan = [], simhash.plan
    monkeypatch.setattr(simhash, "plan", lambda *a, **k: seen.append(plan(*a, **k)) or seen[-1])
    links = [tuple(sorted(p)) for p in zip(*[iter(simhash.majority(similar.shingle_hashes(pa.array([t]), 5)[0]) for t in texts)] * 2, strict=True)]
    near = {i for i, (a, b) in enumerate(links) if (a ^ b).bit_count() <= 2}
    assert len(near) > 50
    nothing = similar.meetings
    monkeypatch.setattr(similar, "meetings", lambda keyed, s: nothing(keyed.limit(0), s))  # without the search beyond the radius
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r["doc_id"]: r["root"] for r in similar.similar_classes(docs).collect()}
    assert {i for i in range(150) if root[2 * i] == root[2 * i + 1]} == near and len(set(root.values())) == 300 - len(near)
    (groups, thresholds), radius = seen[0], 2
    assert sorted(b for g in groups for b in g) == list(range(64)) and sum(thresholds) == radius - len(groups) + 1
    monkeypatch.setattr(similar, "meetings", nothing)
    compare(spark, texts)


def test_shuffle_files_go_with_their_actions(spark, monkeypatch):
    jvm = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f for d in jvm.localDirsString() for f in Path(d).rglob("shuffle_*")}
    before, left = files(), []

    def looked(docs, rooted):
        for _ in range(50):  # they are removed in the background
            if files() <= before:
                break
            time.sleep(0.2)
        left.append(len(files() - before))
        return keep_first(docs, rooted)

    keep_first = similar.keep_first
    monkeypatch.setattr(similar, "keep_first", looked)
    docs = spark.createDataFrame([(i, f"a{i // 2} b c d e f g h i{i // 2} j k l m n") for i in range(60)], "doc_id long, text string")
    assert similar.keep_one_of_similar(docs).count() == 30
    assert left == [0]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
