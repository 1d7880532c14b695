"""The pipeline's stages, each on its own input."""

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from leafmill.llm import tiling


def shingles(text):
    cut = (text or "").lower().split()
    return {tuple(cut[i : i + 5]) for i in range(max(1, len(cut) - 4))}


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    odd = spark.createDataFrame([(900_001, "123 456", "en", "s", 7), (900_002, None, "en", "s", 0)], docs.schema)
    docs, seen = docs.unionByName(odd), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != "tokens":
            assert docs.columns == columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = seen["language"]
    assert ids(before) - ids(after) == {900_001, 900_002}
    before, after = seen["line_dedup"]
    assert ids(before) == ids(after)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = seen["near_duplicates"]
    sets = {r["doc_id"]: shingles(r["text"]) for r in before.collect()}
    left = ids(after)
    similar = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert not any(similar(sets[a], sets[b]) for a in left for b in left if a < b)
    gone = set(sets) - left
    assert gone and all(any(similar(sets[g], s) for i, s in sets.items() if i != g) for g in gone)
    before, after = seen["decontamination"]
    items = tiling.Items([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], 5, 0.8)
    assert ids(before) - ids(after) == {r["doc_id"] for r in before.collect() if items.find(r["text"])}
    before, after = seen["tokens"]
    library, texts = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_tokens", "ids"]


def test_stages_take_odd_tables(spark):
    """Empty tables, repeats, ties, nulls, and columns of clashing names."""
    sf = "/root/testdata/sf0.001"
    text = "the very same words of a text that stands in several rows of this table"
    rows = [(1, text, "en", "s", 5, "a", 1), (1, text, "en", "s", 5, "a", 1), (2, text, "en", "s", 5, "b", 2), (3, None, None, None, None, "c", 3), (None, text + " too", None, "s", 5, "d", 4), (4, "", "en", "s", 0, "e", 5)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", "meta.url", "__id"])
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "tokens" or out.columns == docs.columns
        kept[name] = sorted(str(r["doc_id"]) for r in out.collect())
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert kept == {"language": ["1", "1", "2", "None"], "line_dedup": ["1", "1", "2", "3", "4", "None"], "near_duplicates": ["1", "3"], "decontamination": ["1", "1", "2", "3", "4", "None"], "tokens": ["1", "1", "2", "3", "4", "None"]}
