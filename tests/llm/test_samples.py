"""Training samples stay bounded, whatever repeats."""

import pytest

from leafmill.llm import langid, quality, samples, similar


def test_an_id_that_many_rows_repeat_brings_one_row(spark):
    rows = [(7, f"text number {i}", "en") for i in range(3000)] + [(8, f"texte {i}", "fr") for i in range(50)] + [(7, "texte de sept", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(docs, "lang", 400, 100)
    assert sorted(x for x, _ in got) == ["en", "fr", "fr"]
    assert got == langid.sample(docs.orderBy("text"), "lang", 400, 100)


def test_at_most_so_many_of_each_label(spark):
    docs = spark.range(2000).selectExpr("cast(id as string) as doc_id", "concat('w', id) as text", "id % 3 as label", "'x' as bucket")
    known = docs.select("doc_id", "label")
    rows = samples.one_per_bucket(docs.select("doc_id", "text", "bucket").drop("bucket"), known, 20, lambda i, t: t, ["doc_id"])
    assert all(r["text"] == f"w{r['doc_id']}" for r in rows)
    by = {k: sum(r["label"] == k for r in rows) for k in (0, 1, 2)}
    assert all(0 < n <= 20 for n in by.values())


def test_quality_learns_from_a_bounded_sample(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "train", lambda texts, labels: seen.update(texts=texts, labels=labels))
    docs = spark.createDataFrame([(k % 2, f"row {k}") for k in range(900)] + [(None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (None, 1)], "doc_id long, quality int")
    quality.fit(docs, labels, per_class=10)
    assert seen["labels"] == [1, 0] and len(seen["texts"]) == 2


@pytest.mark.parametrize("similarity", [0.0, 0.4, 1.1])
def test_similarity_has_a_range(spark, similarity):
    with pytest.raises(ValueError):
        similar.similar_classes(spark.createDataFrame([(1, "a")], "doc_id long, text string"), similarity=similarity)


def test_similarity_of_a_half(spark):
    shared = [f"s{i}" for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(shared)), (2, " ".join([*shared, *(f"x{i}" for i in range(290))])), (3, "other")], "doc_id long, text string")
    roots = {r["doc_id"]: r["root"] for r in similar.similar_classes(docs, similarity=0.5).collect()}
    assert roots[1] == roots[2] != roots[3]
