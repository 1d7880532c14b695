"""Toxicity scores against a scan of all examples, planted texts and held-out labels."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from leafmill.llm import toxicity


def plain_cosine(index, a, b):
    def vector(c):
        held = {w: (1 + math.log(n)) * index.idf[index.terms[w]] for w, n in c.items() if w in index.terms}
        size = math.sqrt(sum(x * x for x in held.values()))
        return {w: x / size for w, x in held.items()} if size else {}

    x, y = vector(a), vector(b)
    return sum(v * y.get(w, 0) for w, v in x.items())


@pytest.mark.parametrize("seed", range(6))
def test_nearest_equals_a_scan(seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(40)]
    rng = np.random.default_rng(seed)
    index = toxicity.Index({w: i for i, w in enumerate(words)}, rng.uniform(0.1, 5, len(words)))
    n = random.choice([1, 30, 64, 65, 500])
    examples = [Counter(random.choices([*words, "unknown"], weights=[1 / (i + 1) for i in range(41)], k=random.randint(0, 30))) for _ in range(n)]
    examples[n // 2 :] = [examples[i % 3] for i in range(n - n // 2)]  # ties
    index.fill([index.vector(e) for e in examples])
    for _ in range(40):
        q = Counter(random.choices(words, k=random.randint(0, 12)))
        k, but = random.choice([1, 5, 15]), random.choice([-1, 0, n - 1])
        ids, cosines = index.nearest(*index.vector(q), k, but)
        every = [(plain_cosine(index, q, e), i) for i, e in enumerate(examples) if i != but]
        best = sorted((c for c, _ in every if c > 1e-12), reverse=True)[:k]
        assert np.allclose(cosines, best, atol=1e-12) and len(set(ids.tolist())) == len(ids)
        assert all(abs(plain_cosine(index, q, examples[i]) - c) < 1e-12 for i, c in zip(ids.tolist(), cosines, strict=True))
        for a, b in zip(range(len(ids) - 1), range(1, len(ids)), strict=True):
            assert cosines[a] > cosines[b] or (cosines[a] == cosines[b] and ids[a] < ids[b])


def test_bounds_skip_blocks():
    words = [f"w{i}" for i in range(70)]
    index = toxicity.Index({w: i for i, w in enumerate(words)}, np.ones(70))
    index.fill([index.vector(Counter([words[i // 64], *(["w69"] * (i % 5))])) for i in range(640)])
    seen = []
    index_scores = toxicity.Index.scores
    t, w = index.vector(Counter(["w3"]))

    def spy(self, t, w, blocks):
        seen.extend(blocks.tolist())
        return index_scores(self, t, w, blocks)

    toxicity.Index.scores = spy
    try:
        ids, _ = index.nearest(t, w, 5)
    finally:
        toxicity.Index.scores = index_scores
    assert set(seen) == {3} and all(i // 64 == 3 for i in ids.tolist())


def test_isotonic_is_the_best_step_function():
    rng = np.random.default_rng(5)
    x, w = rng.integers(0, 12, 80) / 12, rng.uniform(0.5, 2, 80)
    y = (rng.uniform(size=80) < x).astype(float)
    steps, levels = toxicity.isotonic(x, y, w)
    assert (np.diff(levels) > 0).all() and (np.diff(steps) > 0).all()
    fitted = levels[np.searchsorted(steps, x, "right") - 1]
    loss = (w * (y - fitted) ** 2).sum()
    for _ in range(300):
        other = np.sort(rng.uniform(size=len(np.unique(x))))
        assert (w * (y - other[np.unique(x, return_inverse=True)[1]]) ** 2).sum() >= loss - 1e-9
    for low in np.unique(levels):  # each pool is at its mean
        assert abs((w * (y - fitted))[fitted == low].sum()) < 1e-9


def tables(spark, rows):
    """rows: (doc_id, text, toxic)"""
    docs = spark.createDataFrame([(d, t, "x", 0.5) for d, t, _ in rows], "doc_id long, text string, label string, score double")
    return docs, spark.createDataFrame([(d, y) for d, _, y in rows if y is not None], "doc_id long, toxic int")


def planted(n=400, seed=3):
    random.seed(seed)
    rows = []
    for i in range(n):
        cut = [random.choice("abcdefghijklmnop") * random.randint(1, 3) for _ in range(40)]
        toxic = i % 5 == 0
        for _ in range(2 * toxic):
            cut[random.randrange(40)] = random.choice(["vile", "nasty"])
        rows.append((i, " ".join(cut), int(toxic)))
    return rows


def test_planted_texts(spark):
    docs, labels = tables(spark, planted())
    model = toxicity.fit(docs, labels)
    asked = spark.createDataFrame([(1, "aa bb VILE cc nasty dd"), (2, "aa bb cc dd"), (3, None), (4, ""), (5, "vile " * 50_000), (1, "aa bb VILE cc nasty dd"), (None, "vile")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["predicted"], round(r["score"], 6), len(r["evidence"])) for r in toxicity.score(asked, model).collect()))
    assert [(d, p) for d, p, _, _ in got] == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 0), (4, 0), (5, 1)]
    assert got[1] == got[2] and got[3][2] == got[4][2] == got[5][2] == round(model.alone, 6)
    toxic = {str(d) for d, _, y in planted() if y}
    for r in toxicity.score(asked.where("doc_id = 5"), model).collect():
        assert r["evidence"] and all(e["doc_id"] in toxic and e["label"] == 1 and 0 < e["similarity"] <= 1 + 1e-9 for e in r["evidence"])


def test_scores_equal_a_plain_version(spark):
    rows = planted(300, 8)
    docs, labels = tables(spark, rows)
    model = toxicity.fit(docs, labels, per_class=50, k=7)
    index = model.index
    df = Counter(w for _, t, _ in rows for w in set(t.split()))
    assert {w: round(index.idf[i], 9) for w, i in index.terms.items()} == {w: round(math.log(301 / df[w]), 9) for w in index.terms}
    text_of = {str(d): t for d, t, _ in rows}
    for r in toxicity.score(docs, model).collect():
        q = Counter(toxicity.terms(text_of[str(r["doc_id"])]))
        near = sorted(((plain_cosine(index, q, Counter(toxicity.terms(text_of[e]))), i) for i, e in enumerate(model.ids)), key=lambda x: (-round(x[0], 9), x[1]))
        near = [(c, i) for c, i in near if c > 1e-9][:7]
        if not near:
            assert r["score"] == model.alone
            continue
        votes = [(c * model.counts_for[model.labels[i]], model.labels[i]) for c, i in near]
        share = sum(v for v, y in votes if y) / sum(v for v, _ in votes)
        around = [model.levels[max(0, np.searchsorted(model.steps, share + d, "right") - 1)] for d in (-1e-9, 1e-9)]
        assert min(abs(r["score"] - x) for x in around) < 1e-9


def test_sample_is_bounded_on_repeated_ids(spark):
    rows = [(7, f"vile {i}", 1) for i in range(300)] + [(8, f"fine {i}", 0) for i in range(300)]
    docs, _ = tables(spark, rows)
    labels = spark.createDataFrame([(7, 1), (8, 0), (7, 1)], "doc_id long, toxic int")
    assert len(toxicity.fit(docs, labels, per_class=5).labels) == 2


def test_without_labels(spark):
    docs, labels = tables(spark, [(1, "a b", None), (2, "vile", 1), (3, None, 1)])
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {1.0}
    empty = toxicity.score(docs.limit(0), toxicity.fit(docs, labels))
    assert empty.count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.query(spark, sf).select("doc_id", "held_out", "score", "predicted")
    rows = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("toxic is not null").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit / sum(r["toxic"] for r in rows) > 0.8 and hit / sum(r["predicted"] for r in rows) > 0.8
    mean = sum(r["score"] for r in rows) / len(rows)
    assert abs(mean - sum(r["toxic"] for r in rows) / len(rows)) < 0.03  # calibrated
