"""Greedy string tiling against a plain version, and planted passages."""

import random
import time

import numpy as np

from leafmill.llm import tiling


def slow_tiles(item, doc, least):
    """The longest match of unmarked words, the first of equals, again and again."""
    a, b, out = [False] * len(item), [d <= 0 for d in doc], []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not a[i + n] and not b[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < least:
            return out
        for k in range(n):
            a[i + k] = b[d + k] = True
        out.append((i, d, n))


def test_tiles():
    random.seed(9)
    for _ in range(150):
        item = [random.randint(1, 6) for _ in range(random.randint(3, 40))]
        doc = [random.randint(0, 6) for _ in range(random.randint(0, 30))] + item[len(item) // 2 :] + [0] + item[: len(item) // 2]
        for least in (2, 3, 5):
            tiles = tiling.tile(np.array(item, dtype=np.int32), np.array(doc, dtype=np.int32), least)
            used_i, used_d = [False] * len(item), [False] * len(doc)
            for i, d, n in tiles:
                assert item[i : i + n] == doc[d : d + n] and n >= least
                assert not any(used_i[i : i + n]) and not any(used_d[d : d + n])
                used_i[i : i + n] = used_d[d : d + n] = [True] * n
            assert tiles == slow_tiles(item, doc, least)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def found(text, coverage=0.8, items=((1, ITEM), (2, "short one here"), (3, None), (4, "..."))):
    return [m["item_id"] for m in tiling.Items(list(items), 5, coverage).find(text)]


def test_planted_passages():
    w = ITEM.split()
    assert found("before " + ITEM.upper() + ", after") == [1]
    assert found("x ".join([" ".join(w[10:]) + " ", "y z ", " ".join(w[:10])])) == [1]  # reordered
    assert found(" ".join(w[:9]) + " or " + " ".join(w[10:])) == [1]  # one word changed
    assert found(" ".join(w[:12])) == [] and found(" ".join(w[:17])) == [1]
    assert found(" ".join(sorted(w))) == [] and found("") == [] and found(None) == []
    assert found("a short one here b") == [2] and found("one short here") == []
    assert found(ITEM + " " + "word " * 100_000) == [1]


def slow_found(doc, item, least=5, coverage=0.8):
    """By the definition, on words; documents without a seed of the item are passed over."""
    a, b = tiling.words(item), tiling.words(doc)
    size = min(least, len(a))
    if not a:
        return False
    seeds = {tuple(a[i : i + size]) for i in range(len(a) - size + 1)}
    under = sorted({j + k for j in range(len(b) - size + 1) if tuple(b[j : j + size]) in seeds for k in range(size)})
    number = {w: k + 1 for k, w in enumerate(dict.fromkeys(a))}
    ids = []
    for k, j in enumerate(under):
        ids += [0] * (k > 0 and under[k - 1] != j - 1) + [number[b[j]]]
    return bool(ids) and sum(n for _, _, n in slow_tiles([number[w] for w in a], ids, size)) >= coverage * len(a)


def test_query_is_every_item_in_every_document(spark):
    sf = "/root/testdata/sf0.001"
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r["doc_id"], r["item_id"]) for r in tiling.query(spark, sf).collect())
    assert got == sorted((d, i) for d, t in docs for i, b in bench if slow_found(t, b)) and got


def test_repeated_words_take_linear_time():
    for n in (300, 2000):
        begun = time.perf_counter()
        assert found("word " * 20_000, items=[(1, "word " * n)]) == [1]
        assert time.perf_counter() - begun < 1
    assert found("a b " * 10_000, items=[(1, "a b " * 500 + "c " * 100), (2, "b a " * 900 + "d " * 900)]) == [1]


def test_seed_join_equals_the_broadcast(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    extra = spark.createDataFrame([(900 + k, t) for k, t in enumerate(["a short one", "word", "word " * 40, ITEM])], "item_id long, text string")
    bench = bench.unionByName(extra)
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "so A short, one here"), (-2, "word " * 500), (None, ITEM + " " + ITEM), (-3, None)], "doc_id long, text string"))
    rows = lambda **k: sorted(map(str, tiling.matches(docs, bench, **k).collect()))
    assert len(rows()) > 4 and rows() == rows(block_bytes=10)
    assert docs.count() - tiling.decontaminate(docs, bench, block_bytes=10).count() == docs.count() - tiling.decontaminate(docs, bench).count() > 3


def test_blocks_repeats_nulls_and_columns(spark):
    docs = spark.createDataFrame([(1, ITEM, 5), (1, ITEM, 5), (None, ITEM, 6), (2, None, 7), (3, "clean text of its own", 8)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(k, ITEM if k % 2 else f"other {k} words in this item") for k in range(6)] + [(9, None)], "item_id long, text string")
    for size in (10_000, 100):
        rows = sorted((r["doc_id"] or 0, r["item_id"]) for r in tiling.matches(docs, bench, block_bytes=size).collect())
        assert rows == sorted([(d, i) for d in (0, 1, 1) for i in (1, 3, 5)])
        kept = tiling.decontaminate(docs, bench, block_bytes=size)
        assert kept.columns == docs.columns and sorted(r["item_id"] for r in kept.collect()) == [7, 8]
    assert tiling.matches(docs, bench.limit(0)).count() == 0 and tiling.decontaminate(docs, bench.limit(0)).count() == 5
    assert tiling.matches(docs.limit(0), bench).count() == 0


def test_ids_of_any_type_and_odd_columns(spark):
    docs = spark.createDataFrame([("x", ITEM, 1, 2), ("y", "clean", 1, 2)], ["doc_id", "text", "meta.url", "__hash"])
    bench = spark.createDataFrame([("one", ITEM)], "item_id string, text string")
    for size in (10, 10_000):
        assert [(r["doc_id"], r["item_id"]) for r in tiling.matches(docs, bench, block_bytes=size).collect()] == [("x", "one")]
        kept = tiling.decontaminate(docs, bench, block_bytes=size)
        assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == ["y"]
