"""Queries equal their SQL on tables of odd rows."""

import oracle

from leafmill.plans import catalog


def check(spark, top, name, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(top / "in" / t))
        file = next((top / "in" / t).glob("*.parquet"))
        file.rename(top / f"{t}.parquet")
    got = oracle.by_spark(catalog.QUERIES[name](spark, str(top)))
    assert got == oracle.by_sql(catalog.ORACLE_SQL[name], str(top))
    return got[1]


def test_detections_that_recur_in_a_paragraph(spark, tmp_path):
    texts = ["no one\nat 10.1.2.3 and a.b@mail.example.com, again 10.1.2.3 and a.b@mail.example.com\n10.1.2.3", "x10.1.2.3 or 10.1.2.3"]
    assert len(check(spark, tmp_path, "attributed_detections", documents=(list(enumerate(texts)), "doc_id long, text string"))) == 6


def test_word_edges_are_those_of_sql(spark, tmp_path):
    texts = ["é10.1.2.3 or 10.1.2.4é", "10.1.2.5"]
    assert len(check(spark, tmp_path, "attributed_detections", documents=(list(enumerate(texts)), "doc_id long, text string"))) == 3


def test_detections_are_made_once(spark, sf):
    from leafmill.operators import anonymize
    from leafmill.plans import privacy

    done = anonymize.anonymize_texts(privacy.detectable(spark, sf), privacy.WHOLE, "salt", existing=3)
    for df in (done.vault, done.rows, done.statistics):
        assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()


def test_references_without_semicolons_are_text(spark, tmp_path):
    page = "<html><body><article><h1>a &amp;&lt b &amp</h1><p>c &#39 d &#39; &quot</p></article></body></html>"
    assert check(spark, tmp_path, "html_tree", pages=([(1, page)], "page_id long, html string"))


def test_references_that_sql_does_not_know_are_text(spark, tmp_path):
    page = "<html><body><article><h1>caf&eacute; &#8217;&mdash; &amp;lt; &notit; &&amp;</h1><p>c &#x27; d&nbsp;&nbsp;e &#39; &AMP; &copy;</p></article></body></html>"
    pages = ([(1, page), (2, None), (None, page)], "page_id long, html string")
    assert len(check(spark, tmp_path, "html_tree", pages=pages)) == 4
    assert len(check(spark, tmp_path, "page_outline", pages=pages)) == 4


def test_given_page_offsets_of_negative_documents(spark, tmp_path):
    texts = ["x\n" * 4000, "y" * 7000 + "\nz", None, "", "a\nb"]
    assert check(spark, tmp_path, "stitch_regions", documents=([(k - 9, t) for k, t in enumerate(texts * 3)], "doc_id long, text string"))


def test_stitching_ends_at_a_missing_batch(spark, tmp_path):
    texts = ["\n".join(["x" * n, "short", "y" * 3000, "z" * 3000, "end"]) for n in (9000, 100, 6001)]
    assert check(spark, tmp_path, "stitch_regions", documents=(list(enumerate(texts)), "doc_id long, text string"))


def test_reading_order_deals_each_text_out_once(spark, tmp_path):
    texts = ["a  b\n\n c ", None, "", "x" * 2999 + "\ny z\nlast"]
    rows = check(spark, tmp_path, "unnest_reading_order", documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert [r[1] for r in rows if "keyValuePair" in r] == [0, 1, 2, 3]
    plan = catalog.QUERIES["unnest_reading_order"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
