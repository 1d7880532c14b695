"""Whole JSON documents: identifiers and strings."""

import json
from hashlib import md5

from leafmill.functions import patterns
from leafmill.operators import compare, documents, identity
from leafmill.sources import layout

DOC = {
    "_id": "keep 123-45-6789",
    "content": "write to ann@example.com",
    "paragraphs": [{"content": "Hello ann@example.com", "boundingRegions": [{"pageNumber": 3}]}, {"content": "x" * 60}],
    "tables": [{"cells": [{"rowIndex": 1, "columnIndex": 2, "content": "c"}, {"content": None}], "boundingRegions": [{"pageNumber": 2}]}],
    "keyValuePairs": [{"key": {"content": "SSN"}, "value": {"content": "123-45-6789"}}],
    "formulas": [{"value": "a+b"}],
    "nested": [["bob@example.com"], {"a/b~c": "bob@example.com"}],
    "n": 1.5,
    "none": None,
}


def short(text):
    return md5(text.encode()).hexdigest()[:6]


def test_ids(spark):
    docs = layout.parse(spark.createDataFrame([("f", json.dumps(DOC))], "source_file string, raw string"))
    got = {(r["kind"], r["place"]): r["id"] for r in identity.assign_ids(docs).collect()}
    assert got == {
        ("paragraphs", "0"): "para_3_0_" + short("para_3_0_Hello ann@example.com"),
        ("paragraphs", "1"): "para_1_1_" + short("para_1_1_" + "x" * 50),
        ("tables", "0"): "table_2_0_" + short("table_2_0_"),
        ("cells", "0/0"): "cell_2_0_1_2_" + short("c"),
        ("cells", "0/1"): "cell_2_0_0_0_" + short(""),
        ("keyValuePairs", "0"): "kv_1_0_" + short("kv_1_0_SSN:123-45-6789"),
        ("formulas", "0"): "formula_1_0_" + short("formula_1_0_a+b"),
    }
    assert compare.duplicates(identity.assign_ids(docs)).count() == 0


def test_anonymized_documents(spark):
    docs = spark.createDataFrame([(1, json.dumps(DOC), 9), (2, "not json", 9), (3, None, 9), (4, json.dumps({"t": "nothing here"}), 9)], "doc_id long, raw string, path int")
    wanted = list(patterns.SHAPES.values())
    out, vault = documents.anonymize_documents(docs, wanted, "salt", 3)
    rows = {r["doc_id"]: r["raw"] for r in out.collect()}
    assert rows[2] == "not json" and rows[3] is None and rows[4] == docs.where("doc_id = 4").first()["raw"]
    d, held = json.loads(rows[1]), {r["original"]: r["placeholder"] for r in vault.collect()}
    assert set(held) == {"ann@example.com", "bob@example.com", "123-45-6789"}
    assert d["_id"] == DOC["_id"] and d["n"] == 1.5 and list(d) == list(DOC)
    assert d["content"] == "write to " + held["ann@example.com"] and d["nested"] == [[held["bob@example.com"]], {"a/b~c": held["bob@example.com"]}]
    assert d["keyValuePairs"][0]["value"]["content"] == held["123-45-6789"]
    twice = spark.createDataFrame([(1, '{"content": "ann@example.com"}'), (1, '{"content": "ann@example.com"}'), (1, '{"content": "bob@example.com", "t": "ann@example.com"}'), (None, '{"content": "bob@example.com"}')], "doc_id long, raw string")
    again, _ = documents.anonymize_documents(twice, wanted, "salt", 3)
    a, b = held["ann@example.com"], held["bob@example.com"]
    assert sorted(json.loads(r["raw"])["content"] for r in again.collect()) == sorted([a, a, b, b])
    only, _ = documents.anonymize_documents(docs, wanted, "salt", 3, all_strings=False)
    text = next(r["raw"] for r in only.collect() if r["doc_id"] == 1)
    assert "ann@" not in text
