"""BPE against the library that the vocabulary is of."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leafmill.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def same(texts):
    by = bpe.encoder(PATH)
    for text, ids in zip(texts, by.encode(texts), strict=True):
        expected = LIBRARY.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, text
        assert by.decode(ids) == LIBRARY.decode(expected, skip_special_tokens=False), text


def test_edges():
    same(["", " ", "a", "it's we'll THE'RE", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|>", "e<|endoftext|>́", "Σίσυφος ΟΔΟΣ", "İstanbul ẞ ǅ", "x" * 5000, "ab" * 3000, "12 ² ½ Ⅷ ٣", "\x1c\x1f\x85​　", "🙂🎉👩‍👩‍👧", "</w> < / w >"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(texts):
    same(texts)


def test_prefixes_are_shared_and_tables_may_empty(monkeypatch):
    random.seed(2)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 50)
    monkeypatch.setattr(bpe, "KNOWN_PAIRS", 20)
    stem = ["un", "der", "stand", "ing", "able", "re", "th"]
    same([" ".join("".join(random.choices(stem, k=random.randint(1, 5))) for _ in range(60)) for _ in range(20)])


def test_query(spark, sf):
    got = {r["doc_id"]: r for r in bpe.query(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_empty(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a b", 6), (1, "a b", 7), (1, "a b", 7)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in bpe.encode(docs, PATH, decode=True).collect())
    assert got == [(0, 2), (1, 0), (1, 2), (1, 2)]
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
