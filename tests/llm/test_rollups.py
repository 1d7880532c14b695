"""Rollups: sums of deltas, batches sent again, batches cut short, compaction."""

import shutil
from collections import Counter

import oracle
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm import bpe, rollups

SCHEMA = "doc_id long, source string, lang string, text string, docs int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_deltas(spark, tmp_path):
    docs = spark.createDataFrame([(1, "s", "en", "a b c", 0), (2, "s", "en", None, 0), (3, None, None, "ü,x 1", 0), (3, None, None, "ü,x 1", 0)], SCHEMA)
    store = rollups.Rollups(spark, str(tmp_path / "r"))
    assert rows(store.totals()) == []
    assert store.commit("one/1", rollups.change(docs, 1, "words-1"))
    first = rows(store.totals())
    assert first == [("s", "en", "words-1", 2, 3), (None, None, "words-1", 2, 4)] or first == sorted([("s", "en", "words-1", 2, 3), (None, None, "words-1", 2, 4)], key=repr)
    assert not store.commit("one/1", rollups.change(docs, 1, "words-1")) and rows(store.totals()) == first
    store.commit("two", rollups.revise(docs.where("doc_id = 3"), "words-1", "pieces-2"))
    assert rows(store.totals()) == sorted([("s", "en", "words-1", 2, 3), (None, None, "pieces-2", 2, 8)], key=repr)
    store.commit("empty", rollups.change(docs.limit(0), 1, "words-1"))
    store.commit("three", rollups.change(docs.where("doc_id < 3"), -1, "words-1"))
    assert rows(store.totals()) == [(None, None, "pieces-2", 2, 8)]


def test_compaction_and_recovery(spark, tmp_path):
    docs = spark.createDataFrame([(1, "s", "en", "a b", 0)], SCHEMA)
    top = tmp_path / "r"
    store = rollups.Rollups(spark, str(top))
    for k in range(3):
        store.commit(f"b{k}", rollups.change(docs, 1, "words-1"))
    (top / "batches/b1/_SUCCESS").unlink()  # as if the writer was lost
    assert rows(store.totals()) == [("s", "en", "words-1", 2, 4)]
    assert store.commit("b1", rollups.change(docs, 1, "words-1"))
    before = rows(store.totals())
    store.compact()
    assert rows(store.totals()) == before == [("s", "en", "words-1", 3, 6)]
    assert not store.commit("b0", rollups.change(docs, 1, "words-1"))
    store.commit("b3", rollups.change(docs, 1, "words-1"))
    store.compact()
    assert rows(store.totals()) == [("s", "en", "words-1", 4, 8)]
    shutil.copytree(next((top / "snapshots").iterdir()), top / "snapshots/zz-unfinished")  # no manifest: not read
    assert rows(store.totals()) == [("s", "en", "words-1", 4, 8)]


def test_query_equals_sql(spark, sf):
    assert oracle.by_spark(rollups.query(spark, sf)) == oracle.by_sql(rollups.SQL, sf)


def test_real_tokenizers(spark, tmp_path, sf):
    """Counts under two public vocabularies' versions, against the library's."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    encoded = bpe.encode(docs, path, keys=("doc_id", "source", "lang")).withColumn("words", F.lit(7)).checkpoint()
    store = rollups.Rollups(spark, str(tmp_path / "r"))
    store.commit("all", rollups.change(encoded, 1, "bpe-49k", F.col("n_tokens")))
    store.commit("recount", rollups.revise(encoded.where("doc_id % 3 = 0"), "bpe-49k", "sevens", (F.col("n_tokens"), F.col("words"))))
    store.commit("gone", rollups.change(encoded.where("doc_id % 3 = 1"), -1, "bpe-49k", F.col("n_tokens")))
    library, expected = Tokenizer.from_file(path), Counter()
    for r in docs.collect():
        if r["doc_id"] % 3 != 1:
            key = (r["source"], r["lang"], "sevens" if r["doc_id"] % 3 == 0 else "bpe-49k")
            expected[key] += 7 if r["doc_id"] % 3 == 0 else len(library.encode(r["text"] or "", add_special_tokens=False).ids)
    assert {tuple(r)[:3]: r["tokens"] for r in store.totals().collect()} == dict(expected)


def test_a_reader_finds_what_it_listed_before_a_compaction(spark, tmp_path):
    docs = spark.createDataFrame([(1, "s", "en", "a b", 0)], SCHEMA)
    store = rollups.Rollups(spark, str(tmp_path / "r"))
    store.commit("b0", rollups.change(docs, 1, "words-1"))
    totals = store.totals()
    store.compact()
    assert rows(totals) == rows(store.totals()) == [("s", "en", "words-1", 1, 2)]
    store.compact()
    assert not list((tmp_path / "r/batches").iterdir()) and rows(store.totals()) == [("s", "en", "words-1", 1, 2)]
