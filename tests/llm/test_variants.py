"""Spelling variants against all pairs in Python."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from leafmill.llm import bitmap, variants


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def slow_counts(docs, min_length, min_count):
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow(docs, min_length=6, min_count=5, ratio=5):
    n = slow_counts(docs, min_length, min_count)
    near = {w: [x for x in n if x != w and one_edit(w, x)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def compare(spark, docs, **k):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, variants.variants(df, **k).collect()))
    assert got == slow(docs, **k)
    return got


def some_docs(seed, n=60):
    random.seed(seed)
    stems = ["letter", "lettter", "leter", "Straße", "crèmes", "cremes", "aaaaaa", "aaaaaaa", "aaaaab", "÷×÷×÷×"]
    docs = []
    for i in range(n):
        words = []
        for _ in range(random.randint(0, 60)):
            w = random.choice(stems)
            for _ in range(random.choice([0, 0, 0, 1, 1, 2])):
                j = random.randrange(len(w))
                w = random.choice([w[:j] + w[j + 1 :], w[:j] + random.choice("abeé") + w[j:], w[:j] + random.choice("abetÿ") + w[j + 1 :]])
            words.append(w)
        docs.append((i if i % 7 else None, random.choice([" ", "-", "ā", "\n"]).join(words)))
    return docs + [(3, None), (4, ""), docs[5], docs[5]]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(spark, seed):
    got = compare(spark, some_docs(seed), min_length=4, min_count=2, ratio=2)
    assert any(r[1] for r in got)


def test_long_chain_of_forms(spark):
    words = {"abcdefgh"[:k] + "z" * (8 - k): 2**k for k in range(9)}
    docs = [(None, " ".join([w] * n)) for w, n in words.items()]
    got = {r[0]: r for r in compare(spark, docs, min_count=1, ratio=2)}
    assert got["zzzzzzzz"][2] == "abcdefgh" and got["abcdefgz"][1] == "abcdefgh"


def test_neighbourhood_is_whole_and_without_repeats():
    letters = "abé"
    every = np.full(1 << bitmap.BITS - 6, np.uint64(2**64 - 1))
    for word in ("a", "aab", "abba", "bééé", "aaaa"):
        made = [t for _, t in variants.neighbours([word], letters, every, 0)]
        cut = [word[:i] + word[i + 1 :] for i in range(len(word))]
        put = [word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters]
        other = [word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters]
        assert sorted(made) == sorted({*cut, *put, *other} - {word})


def test_bitmap_holds_what_was_put_in(spark):
    words = [f"wörd{i * 7919}x" for i in range(3000)]
    h = variants.hashes(words)
    bits = bitmap.of(spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h long"))
    assert bitmap.holds(bits, h).all() and bitmap.holds(bits, variants.hashes([w + "q" for w in words])).mean() < 0.01
    texts = variants.neighbours([words[0][:-1], words[1] + "x"], "x", bits, 0)
    assert sorted(texts) == [(0, words[0]), (1, words[1])]


def test_checksums():
    _, index, distinct = variants.runs(["ab " + "é" * 40 + " abc " + "x" * 300, None, "q"])
    prefixes = np.array([crc32(b"17:")] * len(index), dtype=np.uint32)
    expected = [crc32(b"17:" + distinct[i].as_py().encode()) for i in index.tolist()]
    assert variants.checksums(prefixes, distinct, index).tolist() == expected


def test_odd_tables(spark):
    df = spark.createDataFrame([], "doc_id string, text string, word string, n long, near string")
    assert variants.variants(df).count() == 0
    rows = [("a", "Letters " * 40_000, "w", 1, "x"), ("b", "12 34", "w", 1, "x"), ("c", None, "w", 1, "x")]
    got = [tuple(r) for r in variants.variants(spark.createDataFrame(rows, df.schema)).collect()]
    assert got == [("letters", None, "letters", 40_000, 0, None)]


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, variants.query(spark, sf).collect())) == slow(docs)
