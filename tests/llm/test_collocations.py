"""Phrase collocations against plain counts in Python, and against their SQL."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import oracle
import pytest

from leafmill.llm import collocations


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", lower)]


def slow(docs, max_words, min_count, top, percent):
    """docs: (text, lang) pairs."""
    f = defaultdict(Counter)
    n = Counter()
    for text, lang in docs:
        for w in pieces(text):
            n[lang or "und" if lang is None else lang] += len(w)
            for m in range(1, max_words + 1):
                for i in range(len(w) - m + 1):
                    f[lang if lang is not None else "und"][tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < min_count:
                continue
            cuts = [(Fraction(1000000 * a * a, counts[p[:k]] * counts[p[k:]]).__floor__(), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = max((b for q, b in counts.items() if len(q) > len(p) and b >= min_count and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))), default=0)
            if 100 * longer < percent * a:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def compare(spark, docs, max_words=3, min_count=2, top=50, percent=50):
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    got = sorted(map(tuple, collocations.collocations(df, max_words, min_count, top, percent).collect()))
    assert got == slow(docs, max_words, min_count, top, percent)
    return got


def some_docs(seed, n=60):
    random.seed(seed)
    word = lambda: random.choice(["the", "The", "of", "ÉTÉ", "été", "a", "b", "new york", "x\ty", "…", "end.", "mid,dle", "z\r", "q\x0bq"])
    docs = [(" ".join(word() for _ in range(random.randint(0, 40))), random.choice(["en", "fr", None, ""])) for _ in range(n)]
    return docs + [(None, "en"), ("", "de"), ("  \t ", None), docs[0], docs[0]]


@pytest.mark.parametrize("max_words", [2, 3, 4])
def test_counts_and_scores(spark, max_words):
    assert compare(spark, some_docs(max_words), max_words)


def test_shards_of_any_size_agree(spark, monkeypatch):
    docs = some_docs(9)
    whole = compare(spark, docs)
    words = collocations.Words([t for t, _ in docs], [x or "" for _, x in docs])
    counts = []
    for size in (1, 2, 7, 1_000_000):
        monkeypatch.setattr(collocations, "SHARD", size)
        found = Counter()
        for ids, at, _ in collocations.shards(words, 3, {}):
            for m, first, n in collocations.intervals(ids, collocations.suffix_order(ids, at, 3), [1, 2, 3]):
                found.update(dict(zip(words.phrases(first, m, ids).to_pylist(), n.tolist(), strict=True)))
        counts.append(found)
    assert counts[0] == counts[1] == counts[2] == counts[3] and whole


def test_bitmap_without_room_only_lets_more_through(spark, monkeypatch):
    docs = some_docs(4)
    plain = compare(spark, docs)
    monkeypatch.setattr(collocations.bitmap, "of", lambda hashes, probes: np.full(1 << 20, np.uint64(2**64 - 1)))
    assert compare(spark, docs) == plain


def test_longer_phrases_replace_shorter_ones(spark):
    got = compare(spark, [("deep blue sea", "en")] * 4 + [("deep blue sky", "en")] + [("blue sea", "en")] * 9, percent=50)
    assert [r[2] for r in got] == ["blue sea", "deep blue sea"]


def test_scores_past_64_bits(spark):
    counts = spark.createDataFrame([("x", 2, "a b", 3 * 10**12), ("x", 1, "a", 3 * 10**12 + 7), ("x", 1, "b", 7 * 10**14)], "lang string, size int, phrase string, n long")
    (row,) = collocations.scored(counts).collect()
    assert row["score"] == 1000000 * (3 * 10**12) ** 2 // ((3 * 10**12 + 7) * 7 * 10**14)


def test_odd_tables(spark):
    df = spark.createDataFrame([], "text string, lang string, n long, size int, phrase string")
    assert collocations.collocations(df).count() == 0
    rows = [("long " * 30_000 + "one two", "en", 1, 2, "x")] * 2 + [(None, None, 1, 2, "y")]
    got = collocations.collocations(spark.createDataFrame(rows, df.schema), min_count=2).collect()
    assert [(r["phrase"], r["a"]) for r in got if r["phrase"].endswith("two")] == [("long one two", 2)]
    with pytest.raises(ValueError):
        collocations.collocations(df, max_words=1)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    found = oracle.by_spark(collocations.query(spark, sf))
    assert found == oracle.by_sql(collocations.SQL, sf) and len(found[1]) > 100


def test_tasks_are_halved_but_not_below_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    for given, left in ((1, 1), (cores, cores), (cores + 1, cores), (4 * cores + 1, 2 * cores + 1)):
        rows = spark.range(100).repartition(given)
        kept = collocations.fewer_tasks(rows)
        assert kept.rdd.getNumPartitions() == left
        assert kept.count() == 100
