"""Operators against plain Python, and the cases that tables lack."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leafmill.functions import dates, patterns
from leafmill.functions.entities import infer_entity_type
from leafmill.functions.ids import element_id, region_page
from leafmill.functions.text import lossy_utf8, not_blank, occurrences, similarity, stripped
from leafmill.model import AnonymizationConfig, FilterConfig
from leafmill.operators import anonymize, compare, filtering, headings, privacy, prompt, segment, stitch, unnest
from leafmill.sources import layout, markup


def test_stitch_is_the_sequential_rule(spark):
    random.seed(3)
    rows, expected = [], {}
    for doc in range(40):
        top = length = None
        for k in range(random.randint(1, 6)):
            lo = random.randint(1, 30)
            hi, n = lo + random.randint(0, 5), random.randint(0, 50)
            rows.append((doc, k, n, lo, hi))
            if top is None:
                offset, top, length = (0, 0), hi, n
            else:
                page = 0 if lo == top + 1 else top - lo + 1
                offset, top, length = (length, page), hi + page, length + n
            expected[doc, k] = offset
    df = spark.createDataFrame(rows, "doc_id long, batch_no long, content_length long, first_page long, last_page long")
    got = {(r["doc_id"], r["batch_no"]): (r["content_offset"], r["page_offset"]) for r in stitch.batch_offsets(df).collect()}
    assert got == expected


@pytest.mark.parametrize("rule", ["rich", "filtered"])
def test_segments_are_the_fold(spark, rule):
    random.seed(5)
    rows, expected = [], []
    least, most = 20, 45
    for doc in range(30):
        held, number, filled = 0, int(rule == "rich"), False
        for seq in range(random.randint(1, 40)):
            tokens, level = random.choice([0, 3, 9, 60]), random.choice([None, None, 1, 2, 3])
            head, over = level in (1, 2), held + tokens > most
            if filled and ((held >= least and (head or over)) if rule == "rich" else (over or (held >= least and head))):
                number, held = number + 1, 0
            held, filled = held + tokens, True
            rows.append((doc, seq, tokens, level))
            expected.append((doc, seq, number))
    df = spark.createDataFrame(rows, "doc_id long, seq long, tokens long, level int")
    got = segment.number_segments(df, least, most, rule)
    assert sorted((r["doc_id"], r["seq"], r["segment_id"]) for r in got.collect()) == expected


def test_segment_limits():
    for least, most in ((0, 5), (5, 5), (-1, 2)):
        with pytest.raises(ValueError):
            segment.check_limits(least, most)


def test_headings_in_force_are_the_loop(spark):
    random.seed(8)
    rows, expected = [], {}
    for doc in range(10):
        heads = [None] * 7
        for seq in range(60):
            role, text = random.choice(["H1", "h2", "h3", "h6", "title", "sectionHeading", "text", None]), f"t{doc}.{seq}"
            level = {"title": 1, "sectionHeading": 2}.get(role) or (int(role[1]) if role and role[0] in "Hh" else None)
            if level:
                heads[level:] = [text] + [None] * (6 - level)
            rows.append((doc, seq, role, text))
            expected[doc, seq] = tuple(heads[1:])
    df = spark.createDataFrame(rows, "doc_id long, seq long, role string, content string")
    got = headings.with_context(df, headings.heading_level(F.col("role")))
    assert {(r["doc_id"], r["seq"]): tuple(r[f"h{k}"] for k in range(1, 7)) for r in got.collect()} == expected


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, not_blank(lit("   \x1c\n")), not_blank(lit("")), not_blank(lit(None).cast("string")), not_blank(lit(" x "))) == (False, False, False, True)
    assert one(spark, stripped(lit("  a b \x1f")), occurrences(lit("aaaa"), lit("aa")), occurrences(lit("aaaa"), lit(""))) == ("a b", 2, 0)
    assert one(spark, similarity(lit("a b"), lit("a b")), similarity(lit(""), lit("a")), similarity(lit(None).cast("string"), lit("a"))) == (1.0, 0.0, 0.0)
    assert one(spark, lossy_utf8(F.unhex(lit("61FF62"))))[0] == "a�b"
    assert one(spark, element_id("para", lit(1), lit(0), lit("Hello")))[0] == "para_1_0_" + __import__("hashlib").md5(b"para_1_0_Hello").hexdigest()[:6]
    assert one(spark, region_page(F.expr("cast(null as array<struct<pageNumber:int>>)")))[0] == 1


@pytest.mark.parametrize(
    ("text", "kind"),
    [("[REDACTED_US_SSN_12]", "US_SSN"), ("[REDACTED_X_y]", "OTHER"), ("a@b", "EMAIL_ADDRESS"), ("abc-de-fghi", "US_SSN"), ("2024-01-02", "DATE_TIME"), ("(555) 010-1234", "PHONE_NUMBER"), ("+1 555 010 1234", "OTHER"), ("New York", "PERSON"), ("Élan Vital", "PERSON"), ("new York", "OTHER"), ("", "OTHER")],
)
def test_entity_rules(spark, text, kind):
    assert one(spark, infer_entity_type(F.lit(text)))[0] == kind


def test_dates(spark):
    cases = {"2024-01-30": "2024-02-09", "1/30/2024": "02/09/2024", "January 30, 2024": "February 09, 2024", "January 30, 2024 at 03:45 PM": "February 09, 2024 at 03:45 PM", "soon": None}
    for original, expected in cases.items():
        assert one(spark, dates.rendered(F.lit(original), dates.shifted(F.lit(original), F.lit(10))))[0] == expected
    assert dates.session_shift("a", 0) == 0
    shifts = {dates.session_shift(str(k), 3) for k in range(200)}
    assert shifts == {-3, -2, -1, 1, 2, 3}
    noisy = {dates.session_shift(str(k), 100, 0.2) for k in range(4000)}
    assert max(noisy) > 110 and min(noisy) < -110 and max(map(abs, noisy)) <= 120 and 0 not in noisy
    assert dates.session_shift("a", 100, 0.2) == dates.session_shift("a", 100, 0.2)
    for bad in ((-1, 0.0), (1, 1.0), (1, -0.1)):
        with pytest.raises(ValueError):
            dates.session_shift("a", *bad)
    assert datetime


def test_restoration_goes_by_length(spark):
    vault = spark.createDataFrame([(1, 0, "A", "x"), (1, 1, "AB", "y"), (1, 2, "_date", "no"), (1, 3, "", "no"), (1, 4, "Q", None)], "session_id long, seq long, placeholder string, original string")
    texts = spark.createDataFrame([(1, 1, "AB A _date Q"), (2, 9, "AB"), (3, 1, None)], "text_id long, session_id long, text string")
    got = {r["text_id"]: r["text"] for r in privacy.restore(texts, vault).collect()}
    assert got == {1: "y x _date Q", 2: "AB", 3: None}


def test_surrogates_keep_formats(spark):
    rows = [("BATES_NUMBER", "ABC_001234"), ("BATES_NUMBER", "001234"), ("CASE_NUMBER", "7:98-ab-13579"), ("CASE_NUMBER", "1987-ZZ-24680"), ("MEDICAL_RECORD_NUMBER", "MRN: 0012345"), ("OTHER_THING", "x1")]
    df = spark.createDataFrame(rows, "entity_type string, original string")
    got = {r["original"]: r["s"] for r in privacy.format_preserving(privacy.with_digits(df, "salt"), "s").collect()}
    import re

    for original, shape in (("ABC_001234", r"ABC_[1-9]\d{5}"), ("001234", r"\[REDACTED_BATES_NUMBER\]"), ("7:98-ab-13579", r"[1-9]:2[0-4]-ab-\d{5}"), ("1987-ZZ-24680", r"202[0-4]-ZZ-\d{5}"), ("MRN: 0012345", r"MRN: [1-9]\d{6}"), ("x1", r"\[REDACTED_OTHER_THING\]")):
        assert re.fullmatch(shape, got[original]), (original, got[original])


def test_vault_placeholders_are_unique(spark):
    found = spark.createDataFrame([(i, "LOCATION" if i % 2 else "CUSTOM", f"v{i}") for i in range(50)], "text_id long, entity_type string, original string")
    rows = privacy.build_vault(found, "s", 5).collect()
    assert len({r["placeholder"] for r in rows}) == 50


def test_pattern_merge():
    merged = patterns.merge(patterns.by_sets(["legal", "nothing"]), [{"name": "X", "expressions": ["(x)"]}])
    assert [p.name for p in merged] == ["BATES_NUMBER", "CASE_NUMBER", "COURT_FILING", "X"]
    assert merged[-1].score == 0.8 and merged[-1].languages == ("en",)
    with pytest.raises(ValueError):
        patterns.merge([], [{"name": "X"}])
    assert patterns.entity_types([], merged) == ["BATES_NUMBER", "CASE_NUMBER", "COURT_FILING", "X"]
    assert patterns.entity_types(["PERSON"], merged[-1:]) == ["PERSON", "X"]


def test_prompt_instructions_around(spark):
    parts = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "INSTRUCTIONS", "i"), (1, 2, "b", "file"), (2, 0, "instructions", "only")], "prompt_id long, ord int, tag string, value string")
    files = spark.createDataFrame([(1, "file", bytearray(b"body\xff"))], "prompt_id long, name string, body binary")
    got = {r["prompt_id"]: r["prompt"] for r in prompt.compose(parts, files).collect()}
    i = "<INSTRUCTIONS>\ni\n</INSTRUCTIONS>"
    assert got[1] == f"{i}\n\n<a>\nx\n</a>\n\n<b>\nbody�\n</b>\n\n{i}"
    assert got[2] == "<instructions>\nonly\n</instructions>\n\n\n\n<instructions>\nonly\n</instructions>"


def test_layout_json(spark, tmp_path):
    doc = {
        "content": "Title text",
        "pages": [{"pageNumber": 1, "words": [{"content": "Title"}], "lines": [{"content": "Title"}]}],
        "paragraphs": [{"content": "text", "spans": [{"offset": 6, "length": 4}], "boundingRegions": [{"pageNumber": 2}], "_id": "p1", "odd": 1}, {"content": "Title", "role": "title", "spans": [{"offset": 0, "length": 5}]}],
        "tables": [{"rowCount": 1, "columnCount": 1, "cells": [{"rowIndex": 0, "columnIndex": 0, "content": "c"}]}],
        "keyValuePairs": [{"key": {"content": "k"}, "value": {"content": "v"}}],
    }
    (tmp_path / "d.json").write_text(json.dumps(doc))
    docs = layout.read_documents(spark, str(tmp_path))
    rows = layout.elements(docs)
    order = unnest.reading_order(rows).orderBy("seq").collect()
    assert [(r["element_type"], r["content"], r["page_number"]) for r in order] == [("word", "Title", 1), ("line", "Title", 1), ("paragraph", "text", 2), ("paragraph", "Title", None), ("table", None, None), ("keyValuePair", None, None)]
    assert order[2]["keys"] == ["content", "spans", "boundingRegions", "_id", "odd"]
    cut = unnest.by_offset(rows.where("scope = 'doc'")).orderBy("seq").collect()
    assert [(r["kind"], r["content"]) for r in cut] == [("paragraphs", "Title"), ("tables", None), ("keyValuePairs", None), ("paragraphs", "text")]
    kept = filtering.filter_elements(unnest.reading_order(rows), FilterConfig("citation_optimized"))
    assert [r["id"] for r in kept.collect()] == ["p1"]
    assert layout.structure_flags(docs).first()["keys"] == "content,keyValuePairs,pages,paragraphs,tables"


def test_acceptable_files(spark):
    f = spark.createDataFrame([("a/b.PDF", 5), ("a/b.exe", 5), ("b.md", 200 * 1024 * 1024)], "path string, length long")
    assert [r["fault"] for r in layout.acceptable(f).collect()] == [None, "unsupported format", "too large"]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "doc_id long, seq long, id string, content string, role string, element_type string, page_number long, keys array<string>")
    assert filtering.filter_elements(e, FilterConfig()).count() == 0
    assert filtering.element_mappings(e).count() == 0
    assert segment.number_segments(e.select("doc_id", "seq", F.lit(1).cast("long").alias("tokens"), F.lit(1).alias("level")), 1, 2, "rich").count() == 0


def test_unknown_preset_lets_all_through(spark):
    e = spark.createDataFrame([(1, 0, "a", " x ", "h1", "paragraph", 1, ["content"]), (1, 1, None, "y", None, "paragraph", 1, ["content"]), (1, 2, "b", " ", None, "paragraph", 1, ["content"])], "doc_id long, seq long, id string, content string, role string, element_type string, page_number long, keys array<string>")
    got = filtering.filter_elements(e, FilterConfig("none such")).collect()
    assert [(r["id"], r["content"]) for r in got] == [("a", " x ")]
    got = filtering.filter_elements(e, FilterConfig("x", ("pageNumber",))).collect()
    assert [(r["page_number"], r["content"]) for r in got] == [(1, "x")]


def test_differences_ignore_ids(spark):
    a = spark.createDataFrame([(1, "a", "i"), (2, "b", "i")], "k long, v string, id string")
    assert compare.differences(a, a.withColumn("id", F.lit("j"))).count() == 0


def test_dates_in_words(spark):
    cases = {
        "Jan 5, 2024": (2024, 1, 5), "5 January 2024": (2024, 1, 5), "January 5 2024": (2024, 1, 5), "2024/01/05": (2024, 1, 5), "2024-1-5": (2024, 1, 5), "01-05-2024": (2024, 1, 5),
        "1/5/24": (2024, 1, 5), "25/12/1999": (1999, 12, 25), "seen on the 3rd of Mar. 1987, twice": (1987, 3, 3), "01.02.1970": (1970, 1, 2), "Section 1.2.2024": None, "1.2.70": None, "Feb 30, 2024": None, "2024-13-40": None, "": None, "may be": None, "1:30 pm": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", dates.parsed(F.col("t")).alias("d")).collect()}
    assert {k: v and (v.year, v.month, v.day) for k, v in got.items()} == cases
    assert one(spark, dates.rendered(F.lit("Jan 5, 2024 12:30 am"), dates.shifted(F.lit("Jan 5, 2024 12:30 am"), F.lit(1))))[0] == "January 06, 2024 at 12:30 AM"


def test_vault_keeps_what_is_known(spark):
    found = spark.createDataFrame([(1, "CUSTOM", "a"), (1, "CUSTOM", "b"), (2, "US_SSN", "1")], "text_id long, entity_type string, original string")
    first = {r["original"]: r["placeholder"] for r in privacy.build_vault(found, "s", 5).collect()}
    more = found.union(spark.createDataFrame([(3, "CUSTOM", "0")], found.schema))
    assert {r["original"]: r["placeholder"] for r in privacy.build_vault(more, "s", 5).collect()} == first | {"0": next(r["placeholder"] for r in privacy.build_vault(more, "s", 5).collect() if r["original"] == "0")}
    known = spark.createDataFrame([("a", "kept"), ("other", first["1"])], "original string, placeholder string")
    again = {r["original"]: r["placeholder"] for r in privacy.build_vault(found, "s", 5, known).collect()}
    assert again["a"] == "kept" and again["b"] == first["b"] and again["1"].startswith(first["1"] + "~")


def test_sessions_keep_their_state(spark):
    config = AnonymizationConfig(entity_types=("EMAIL_ADDRESS", "DATE_TIME"), date_shift_days=30, pattern_sets=("legal",), custom_patterns=({"name": "CODE", "expressions": [r"\b(X\d+)\b"]},))
    assert [p.name for p in anonymize.detectors(config)] == ["DATE_TIME", "EMAIL_ADDRESS", "BATES_NUMBER", "CASE_NUMBER", "COURT_FILING", "CODE"]
    texts = spark.createDataFrame([(1, "ann@example.com on 2024-01-05, X12"), (2, None), (3, "plain")], "text_id long, text string")
    first = anonymize.anonymize_texts(texts, config, "salt")
    rows = {r["text_id"]: r["text"] for r in first.rows.collect()}
    assert rows[2] is None and rows[3] == "plain" and "ann@" not in rows[1] and "X12" not in rows[1] and "2024-01-05" not in rows[1]
    assert {r["entity_type"]: r["n"] for r in first.statistics.collect()} == {"EMAIL_ADDRESS": 1, "DATE_TIME": 1, "CODE": 1}
    data = anonymize.write_state(first).first()["vault"]
    assert data[0] == ["_date_offset", str(first.days)] and len(data) == 4
    known, offset = anonymize.read_state(spark, data)
    again = anonymize.anonymize_texts(texts, config, "another salt", known, offset)
    assert {r["text_id"]: r["text"] for r in again.rows.collect()} == rows and anonymize.read_state(spark, None) == (None, None)
    assert sorted(anonymize.write_state(again, known).first()["vault"]) == sorted(data)
    docs = spark.createDataFrame([("d", json.dumps({"content": "ann@example.com"}))], "doc_id string, raw string")
    held = {r["original"]: r["placeholder"] for r in known.collect()}
    assert json.loads(anonymize.anonymize_json(docs, config, "z", known, offset).rows.first()["raw"])["content"] == held["ann@example.com"]
    merged = anonymize.merge_statistics(first.statistics, again.statistics)
    assert {r["entity_type"]: r["n"] for r in merged.collect()} == {"EMAIL_ADDRESS": 2, "DATE_TIME": 2, "CODE": 2}


def test_json_sizes_are_those_of_python(spark):
    texts = ["plain", 'quo"te\\ back', "tab\t nl\n \x01 \x0b \x1f \x7f", "äöü € 漢 😀", ""]
    rows = [(k, f"i{k}" if k % 2 else None, t, None, k * 100) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, id string, content string, role string, page_number long")
    got = {r["doc_id"]: (r["original_bytes"], r["json_bytes"]) for r in filtering.sizes(df).collect()}
    for k, i, t, _, n in rows:
        held = {c: v for c, v in (("id", i), ("content", t), ("page_number", n)) if v is not None}
        assert got[k] == (len(json.dumps(held, ensure_ascii=False, separators=(",", ":")).encode()) + 1, len(json.dumps(held)) + 2)


def test_faulty_elements_are_skipped(spark):
    df = spark.createDataFrame([(1, 0, 5, None), (1, 1, None, 1), (1, 2, 30, None), (1, 3, 30, None)], "doc_id long, seq long, tokens long, level int")
    cut = segment.number_segments(df, 20, 45, "rich", skip_faulty=True).collect()
    assert sorted((r["seq"], r["segment_id"]) for r in cut) == [(0, 1), (2, 1), (3, 2)]


def test_strict_batches(spark):
    ok = spark.createDataFrame([(1, '{"content": "", "pages": []}')], "batch_no long, raw string")
    assert stitch.require_valid(ok).count() == 1
    with pytest.raises(ValueError, match="pages are missing"):
        stitch.require_valid(ok.withColumn("raw", F.lit('{"content": "x"}')))


def test_sources(spark, tmp_path):
    files = spark.createDataFrame([("a.html", "<html><head><title>t</title></head><body><h2>Head &amp; <b>more</b></h2><p>one<br>two<ul><li>x</li><li> </li></ul><table><tr><td>a</td><td>b</td></tr></table><!-- <p>no</p> --></body></html>"), ("b.md", "# Head #\ntext of\none paragraph\n\n* item\n1. first\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"), ("c.txt", "one\r\n\n two  words"), ("d.md", None)], "path string, text string")
    got = sorted((r["doc_id"], r["seq"], r["kind"], r["level"], r["content"]) for r in markup.read_markup(files).collect())
    assert [(d, k, n, c) for d, _, k, n, c in got] == [
        ("a.html", "heading", 2, "Head & more"), ("a.html", "paragraph", None, "one two"), ("a.html", "list", None, "x"), ("a.html", "table", None, "a b"),
        ("b.md", "heading", 1, "Head"), ("b.md", "paragraph", None, "text of one paragraph"), ("b.md", "list", None, "item"), ("b.md", "list", None, "first"), ("b.md", "table", None, "a b"), ("b.md", "table", None, "1 2"),
        ("c.txt", "paragraph", None, "one"), ("c.txt", "paragraph", None, "two words"),
    ]
    counted = {r["doc_id"]: (r["headings"], r["paragraphs"], r["lists"], r["tables"]) for r in markup.element_statistics(markup.read_markup(files)).collect()}
    assert counted["b.md"] == (1, 1, 2, 2)

    def pages(body):
        if not body.startswith(b"%"):
            raise ValueError
        return body.count(b"p")

    bodies = spark.createDataFrame([("x", bytearray(b"%pp")), ("y", bytearray(b"no"))], "path string, body binary")
    held = layout.page_counts(bodies, pages)
    assert {r["path"]: r["n_pages"] for r in held.collect()} == {"x": 2, "y": None}
    ranges = stitch.page_ranges(held, "n_pages", 1, "path")

    def extractor(frames):
        for f in frames:
            yield f.assign(raw="{}")[["path", "first_page", "raw"]]

    out = layout.extract(ranges, extractor, "path string, first_page long, raw string")
    layout.write_json(out, str(tmp_path / "out"), ["path"])
    assert sorted((r["path"], r["first_page"]) for r in spark.read.json(str(tmp_path / "out")).collect()) == [("x", 1), ("x", 2)]


def test_raw_elements_by_key(spark):
    rows = [(1, 0, '{"_id": null, "id": "a", "content": "x"}', None), (1, 1, '{"id": "a", "content": " x ", "page_number": 3, "odd": {"k": [1]}}', "S"), (1, 2, "[1]", None), (1, 3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, seq long, raw string, parent_section string")
    got = [(r["filtered_index"], r["element_id"], r["fields"]) for r in filtering.filter_raw(df, FilterConfig("no_filter")).collect()]
    assert got == [(0, "a", {"id": "a", "content": " x ", "page_number": "3", "odd": '{"k":[1]}', "_id": "a"})]
    got = [r["fields"] for r in filtering.filter_raw(df, FilterConfig("x", ("pageNumber", "parentSection"), False)).collect()]
    assert got == [{"pageNumber": "3", "parentSection": "S", "content": "x"}]
