"""SimHash against all pairs, and in tables with hot groups, nulls and repeats."""

import random
import re

import numpy as np
import pytest
import xxhash

from leafmill.llm import simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fingerprints, radius=2):
    values = sorted(set(fingerprints))
    a, parent = np.array(values, dtype=np.uint64), list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.nonzero(np.bitwise_count(a ^ a[i]) <= radius)[0]:
            x, y = find(i), find(int(j))
            parent[max(x, y)] = min(x, y)
    return {v: find(i) for i, v in enumerate(values)}


@pytest.mark.parametrize("text", [None, "", "  \t", "One", "One two", "A B C", "Ünï CÖDE über x", "a\x0bb\x1cc d", "x " * 9000, "w" * 50000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_query_equals_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(spark, sf).collect()}
    marks = {r["doc_id"]: slow_fingerprint(r["text"]) for r in docs}
    root, least = classes(marks.values()), {}
    for d, f in marks.items():
        least[root[f]] = min(d, least.get(root[f], d))
    assert found == {d: (f"{f:016x}", least[root[f]]) for d, f in marks.items()}


@pytest.mark.parametrize(("radius", "limit"), [(0, 4), (1, 4), (2, 4), (2, 64)])
def test_components_of_dense_groups(spark, radius, limit):
    random.seed(radius * 100 + limit)
    values = set()
    for _ in range(6):  # chains and balls around a few centres
        c = random.getrandbits(64)
        for _ in range(60):
            c ^= 1 << random.randrange(64)
            values |= {c, c ^ 1 << random.randrange(64)}
    values |= {random.getrandbits(64) for _ in range(50)}
    rows = [(i, int(np.array(v, dtype=np.uint64).astype(np.int64))) for i, v in enumerate(sorted(values))]
    marks = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    got = {r["fingerprint"] % (1 << 64): r["component_id"] for r in simhash.classify(marks, radius, limit).collect()}
    root = classes(values, radius)
    ids = {v: i for i, v in enumerate(sorted(values))}
    least = {}
    for v in values:
        least[root[v]] = min(ids[v], least.get(root[v], ids[v]))
    assert got == {v: least[root[v]] for v in values}


@pytest.mark.parametrize("cut", [([32, 32], [0, 1]), ([32, 32], [1, 0]), ([64], [2]), ([20, 22, 22], [0, 0, 0]), ([10, 22, 32], [-1, 0, 1])])
def test_every_allocation_finds_all_links(spark, monkeypatch, cut):
    sizes, thresholds = cut
    random.seed(7)
    bits = random.sample(range(64), 64)
    groups = [sorted(bits[sum(sizes[:k]) : sum(sizes[: k + 1])]) for k in range(len(sizes))]
    monkeypatch.setattr(simhash, "plan", lambda *_: (groups, thresholds))
    values = set()
    for _ in range(40):
        c = random.getrandbits(64)
        values |= {c, c ^ 1 << random.randrange(64), c ^ 1 << random.randrange(64) ^ 1 << random.randrange(64)}
    rows = [(i, int(np.array(v, dtype=np.uint64).astype(np.int64))) for i, v in enumerate(sorted(values))]
    got = {tuple(sorted((r["u"] % (1 << 64), r["v"] % (1 << 64)))) for r in simhash.links(spark.createDataFrame(rows, "least long, fingerprint long")).collect()}
    assert got == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2} and got


def test_plan_covers_the_radius():
    rng = np.random.default_rng(1)
    p, sizes = rng.uniform(0.3, 0.7, 64), []
    for n in (100, 10_000_000_000):
        together = np.outer(p, p) * n
        np.fill_diagonal(together, p * n)
        groups, thresholds = simhash.plan(n, together)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(thresholds) == 2 - len(groups) + 1 and min(thresholds) >= -1
        sizes.append(len(groups))
    assert sizes[0] >= sizes[1]  # more rows, longer keys


def test_correlated_bits_share_a_group():
    n = 1000
    together = np.full((64, 64), n / 4)
    np.fill_diagonal(together, n / 2)
    for a, b in ((0, 63), (5, 40), (9, 33)):
        together[a, b] = together[b, a] = n / 2
    groups = simhash.group_bits(n, together, 3)
    for a, b in ((0, 63), (5, 40), (9, 33)):
        assert any(a in g and b in g for g in groups)


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "same words in here", "k"), (1, "same words in here", "k"), (2, "same words in here", None), (None, "same words in here", "n"), (3, None, "x"), (4, "", "y"), (None, "alone of its kind", "z"), (None, "alone of its kind", "z"), (7, "quite another text", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted(((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.near_duplicates(docs).collect()))
    assert got == [(-1, -1), (-1, -1), (-1, 1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (7, 7)]
    kept = sorted((r["doc_id"] or -1, r["text"] or "", r["fingerprint"]) for r in simhash.keep_representatives(docs).collect())
    assert kept == [(-1, "alone of its kind", "z"), (1, "same words in here", "k"), (3, "", "x"), (7, "quite another text", "f")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_representatives(docs).count() == 0


def test_columns_of_any_name(spark):
    rows = [(1, "same words in here", 1, 2, "a", "r"), (2, "same words in here", 1, 2, "b", "r"), (3, "other words in there", 3, 4, "c", "r")]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "__rows", "__id", "meta.url", "row"])
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(r["meta.url"] for r in kept.collect()) == ["a", "c"]
    named = spark.createDataFrame([("x", "same words in here"), ("y", "same words in here")], "doc_id string, text string")
    assert [r["doc_id"] for r in simhash.keep_representatives(named).collect()] == ["x"]


def test_settled_edges_need_no_round(spark, monkeypatch):
    kind, seen = type(spark.range(1)), []
    checkpoint = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a: seen.append(1) or checkpoint(self, *a))
    for edges, rounds in (([], 0), ([(1, 2), (1, 5), (3, 4), (1, 2)], 0), ([(1, 2), (2, 3)], 1)):
        seen.clear()
        found = simhash.components(spark.createDataFrame(edges, "u long, v long"))
        root = {r["node"]: r["root"] for r in found.collect()}
        assert root == {1: {}, 5: {1: 1, 2: 1, 5: 1, 3: 3, 4: 3}, 3: {1: 1, 2: 1, 3: 1}}[max([1, *(v for _, v in edges)])]
        assert len(seen) == 1 + rounds


def test_components_of_chains_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100)] + [tuple(sorted(rng.sample(range(200, 400), 2))) for _ in range(120)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        parent[b] = a
    found = simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r["node"], r["root"]) for r in found) == sorted((x, top(x)) for x in parent)
