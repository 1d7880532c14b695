"""Attention-based multiple-instance learning: its gradient, held-out accuracy, and odd rows."""

import zlib
from itertools import chain

import numpy as np

from leafmill.llm import quality


def test_gradient_by_differences():
    rng = np.random.default_rng(3)
    m = quality.train(["a b c " * 40, "x | y | z"], [1, 0], epochs=1)
    m.weights = {k: v.astype(np.float64) for k, v in m.weights.items()}
    bags = [quality.passages(t) for t in ("one two " * 90, "three", "")]
    counts = np.array([len(b) for b in bags])
    x, begins, y = quality.inputs(list(chain.from_iterable(bags)), quality.Buckets()).astype(np.float64), np.cumsum(counts) - counts, np.array([1.0, 0.0, 1.0])

    def loss():
        p = m.forward(x, begins, counts)["score"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in quality.gradient(m, x, begins, counts, y).items():
        w = m.weights[name]
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in w.shape)
            w[at] += 1e-5
            up = loss()
            w[at] -= 2e-5
            down = loss()
            w[at] += 1e-5
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5, name


def test_attention_sums_to_one():
    m = quality.train(["a b c " * 40, "x | y | z"], [1, 0], epochs=1)
    bags = [quality.passages("w " * 400), quality.passages("v")]
    counts = np.array([len(b) for b in bags])
    f = m.forward(quality.inputs(list(chain.from_iterable(bags)), quality.Buckets()), np.cumsum(counts) - counts, counts)
    assert np.allclose(np.add.reduceat(f["a"], [0, counts[0]]), 1) and counts[0] == 7


def plain_score(m, text):
    """A document's score by loops over passages, words and bytes."""
    w, cut = {k: v.astype(np.float64) for k, v in m.weights.items()}, (text or "").split()
    hidden, energy = [], []
    for at in range(0, max(1, len(cut)), 64):
        part = cut[at : at + 64]
        raw, x = " ".join(part).encode(), np.zeros(quality.WIDTH)
        ids = [zlib.crc32(t.lower().encode()) % quality.WORDS for t in part]
        for i in ids:
            x[i] += 1 / len(part)
        for b in raw:
            x[quality.WORDS + b] += 1 / len(raw)
        x = np.sqrt(x)
        x[-4:] = [len(set(part)) / max(1, len(part)), sum(a == b for a, b in zip(ids, ids[1:], strict=False)) / max(1, len(part)), min(4, len(raw) / max(1, len(part)) / 8), len(part) / 64]
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        hidden.append(h)
        energy.append((np.tanh(h @ w["tanh"]) / (1 + np.exp(-(h @ w["gate"])))) @ w["attend"])
    a = np.exp(energy) / np.exp(energy).sum()
    return 1 / (1 + np.exp(-(a @ np.array(hidden) @ w["out"] + w["out_bias"][0])))


def test_query_scores_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("crc32(cast(doc_id as string)) % 5 <> 0")
    m = quality.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.query(spark, sf).collect():
        p = plain_score(m, texts[r["doc_id"]])
        assert abs(p - r["score"]) < 1e-4 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("x", "good words in here"), ("y", "|| ||"), (None, "z")], "doc_id string, text string")
    labels = spark.createDataFrame([("x", 1), ("y", 0)], "doc_id string, quality int")
    assert {r["doc_id"] for r in quality.score(docs, quality.fit(docs, labels)).collect()} == {"x", "y", None}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.query(spark, sf).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] for r in held) and sum(r["held_out"] for r in rows) == len(held)
    known = [r for r in held if r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in known) / len(known) > 0.96


def test_nulls_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "a b", 1.0), (3, "w " * 100_000, 1.0), (3, "w " * 100_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1), (2, 0), (2, 1), (None, 1), (9, 0), (3, None), (3, 7)], "doc_id long, quality int")
    m = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, m).collect()}
    assert got[1] == got[2] and len(got) == 4
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), m).count() == 0
