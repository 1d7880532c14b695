"""The random field against enumeration, finite differences, and held-out rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import langid


def model(k, seed=0):
    rng = np.random.default_rng(seed)
    return langid.Model([f"l{i}" for i in range(k)], np.zeros((langid.BUCKETS, k), dtype=np.float32), np.zeros(k), rng.normal(0, 1, (k, k)), rng.normal(0, 1, k))


def enumerated(m, scores):
    n, k = scores.shape
    out, total = np.zeros((n, k)), 0.0
    for path in itertools.product(range(k), repeat=n):
        w = m.start[path[0]] + sum(scores[i, y] for i, y in enumerate(path)) + sum(m.transitions[a, b] for a, b in itertools.pairwise(path))
        total += np.exp(w)
        for i, y in enumerate(path):
            out[i, y] += np.exp(w)
    return out / total


def test_posteriors_by_enumeration():
    m = model(3)
    scores = np.random.default_rng(1).normal(0, 2, (8, 3)).astype(np.float32)
    assert np.allclose(langid.posteriors(m, scores, [8]), enumerated(m, scores), atol=1e-6)
    assert np.allclose(langid.posteriors(m, scores, [3, 1, 4]), np.concatenate([enumerated(m, scores[a:b]) for a, b in ((0, 3), (3, 4), (4, 8))]), atol=1e-6)


def test_blocks_join_exactly():
    m = model(4, 3)
    rng = np.random.default_rng(2)
    lengths = [1, 63, 64, 65, 500, 128]
    scores = rng.normal(0, 3, (sum(lengths), 4)).astype(np.float32)
    got, at = langid.posteriors(m, scores, lengths), 0
    for n in lengths:
        s = scores[at : at + n].astype(float)
        a = np.zeros((n, 4))
        v = np.exp(m.start + s[0])
        a[0] = v / v.sum()
        for i in range(1, n):
            v = (a[i - 1] @ np.exp(m.transitions)) * np.exp(s[i])
            a[i] = v / v.sum()
        b = np.ones((n, 4))
        for i in range(n - 2, -1, -1):
            v = np.exp(m.transitions) @ (b[i + 1] * np.exp(s[i + 1]))
            b[i] = v / v.sum()
        p = a * b
        assert np.allclose(got[at : at + n], p / p.sum(axis=1, keepdims=True), atol=1e-6)
        at += n


def test_gradient_by_differences():
    rng = np.random.default_rng(5)
    k, x, y = 3, rng.integers(0, 5, (4, 6)), rng.integers(0, 3, (4, 6))
    table, trans, start = rng.normal(0, 1, (5, k)), rng.normal(0, 1, (k, k)), rng.normal(0, 1, k)

    def loss():
        total = 0.0
        for words, labels in zip(x, y, strict=True):
            s = table[words]
            v = start + s[0]
            for i in range(1, len(words)):
                v = np.log(np.exp(v) @ np.exp(trans)) + s[i]
            gold = start[labels[0]] + s[np.arange(len(words)), labels].sum() + trans[labels[:-1], labels[1:]].sum()
            total += np.log(np.exp(v).sum()) - gold
        return total

    for a, g in zip((table, trans, start), langid.gradient(table, trans, start, x, y), strict=True):
        for at in np.ndindex(a.shape):
            a[at] += 1e-5
            up = loss()
            a[at] -= 2e-5
            down = loss()
            a[at] += 1e-5
            assert abs((up - down) / 2e-5 - g[at]) < 1e-3


def test_features_are_of_the_word_alone():
    index, begins = langid.features(["abc", "über", "a", "abc"])
    parts = np.split(index, begins[1:])
    assert sorted(parts[0]) == sorted(parts[3]) and len(parts[2]) > 0
    alone, _ = langid.features(["über"])
    assert sorted(alone) == sorted(parts[1])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = langid.query(spark, sf).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    import zlib

    assert {r["doc_id"] for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_code_switching_is_labelled_by_word(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = langid.fit(docs, per_language=100)
    by = {r["lang"]: langid.words(r["text"]) for r in docs.where("n_chars > 1500").collect()}
    mixed = by["en"][:80] + by["de"][:80] + by["en"][80:120]
    p = langid.Labeller(m).words([mixed])
    best = [m.languages[k] for k in p.argmax(axis=1)]
    truth = ["en"] * 80 + ["de"] * 80 + ["en"] * 40
    assert sum(a == b for a, b in zip(best, truth, strict=True)) > 185


def test_nulls_and_empty(spark):
    rows = [(1, None, "en", 0.0), (2, "", "en", 0.0), (3, "12 .. 34", None, 0.0), (None, "the house is here", "en", 0.0), (4, "the cat is there", "en", 0.0), (5, "das haus ist hier", "de", 0.0), (5, "das haus ist hier", "de", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    m = langid.fit(docs.where("doc_id is not null"), per_language=5)
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(docs, m).collect()]
    assert [x for d, x in got if d in (1, 2, 3)] == ["und"] * 3
    assert langid.keep_known(docs, m).columns == docs.columns and langid.keep_known(docs, m).where("doc_id in (1, 2, 3)").count() == 0
    none = langid.fit(docs.where(F.lit(False)))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.keep_known(docs, none).count() == 4
    assert langid.predict(docs.limit(0), m).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 4, 6])
def test_rejection_follows_the_number_of_languages(spark, k):
    m = langid.Model([f"l{i}" for i in range(k)], np.zeros((langid.BUCKETS, k), dtype=np.float32), np.zeros(k), np.zeros((k, k)), np.zeros(k))
    docs = spark.createDataFrame([(1, "words of no known language"), (2, "1 2 3")], "doc_id long, text string")
    assert langid.keep_known(docs, m).count() == (1 if k == 1 else 0)  # a mere guess; a sole language is no guess
    m.bias[0] = 3.0
    assert [r["doc_id"] for r in langid.keep_known(docs, m).collect()] == [1]


def test_short_training_samples_are_learned(spark):
    rows = [(1, "der hund und die katze", "de"), (2, "the dog and the cat", "en"), (3, "le chien et le chat", "fr"), (4, "el perro y el gato", "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(docs)
    assert langid.keep_known(docs, m).count() == 4 and {(r["doc_id"], r["lang_pred"]) for r in langid.predict(docs, m).collect()} == {(d, x) for d, _, x in rows}
    cut = langid.spliced([("a", [f"w{i}" for i in range(100)])], ["a"], 48, np.random.default_rng(1))
    assert {w for x, _ in cut for w in x} == {f"w{i}" for i in range(100)} and {len(x) for x, _ in cut} == {48}


def test_ids_and_columns_of_any_kind(spark):
    rows = [(f"d{k}", t, x, "u", k) for k, (t, x) in enumerate([("the cat and the dog " * 9, "en"), ("der hund und die katze " * 9, "de"), ("the end and the start " * 9, "en"), ("die and der und " * 9, "de"), ("12", "en"), (None, None)])]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "meta.url", "__0"])
    kept = langid.keep_known(docs, langid.fit(docs))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {"d0", "d1", "d2", "d3"}
