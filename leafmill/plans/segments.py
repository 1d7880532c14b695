"""Queries over segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.text import COUNTERS
from leafmill.operators import filtering, headings, segment
from leafmill.plans.filtering import KEPT
from leafmill.plans.inputs import HEADING_LEVEL, PARAGRAPHS, heads_sql, layout_elements, paragraphs

LEAST, MOST = 150, 400
HEADS = ", ".join(f"h{k}" for k in range(1, 7))


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paragraphs(spark, sf_dir).withColumn("tokens", COUNTERS["chars4"](F.col("content"))).withColumn("level", headings.heading_level(F.col("role")))
    found = headings.with_context(p, F.col("level"))
    return segment.number_segments(found.drop("span_offset", "span_length", "role", "content"), LEAST, MOST, "rich")


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filtering.named(filtering.passing(layout_elements(spark, sf_dir)))
    kept = kept.withColumn("seq", (F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1).cast("long"))
    p = kept.withColumn("tokens", COUNTERS["chars4"](F.col("content"))).withColumn("level", headings.heading_level(F.col("role")))
    found = headings.with_context(p, F.col("level"))
    return segment.number_segments(found.select("doc_id", "seq", "id", "page_number", "tokens", "level", *HEADS.split(", ")), LEAST, MOST, "filtered")


def segment_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segments(rich(spark, sf_dir), "rich")


def segment_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segments(filtered(spark, sf_dir), "filtered")


def segment_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    mappings = filtering.element_mappings(layout_elements(spark, sf_dir))
    return segment.segment_mappings(mappings, filtered(spark, sf_dir)).select("doc_id", "segment_id", "filtered_index", "element_id", "element_type", "page_number", "content_hash")


def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rich(spark, sf_dir).groupBy("doc_id").agg(F.count_distinct("segment_id").alias("segments"), F.sum("tokens").alias("tokens"), F.count_distinct("page_number").alias("pages"))
    return pages.withColumn("tokens_per_segment", F.round(F.col("tokens") / F.col("segments"), 6))


def segment_faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of documents some of whose elements could not be counted: they are left out."""
    p = paragraphs(spark, sf_dir).withColumn("tokens", F.when(F.pmod("seq", F.lit(5)) != 3, COUNTERS["chars4"](F.col("content")))).withColumn("level", headings.heading_level(F.col("role")))
    cut = segment.number_segments(p.select("doc_id", "seq", "tokens", "level"), LEAST, MOST, "rich", skip_faulty=True)
    return cut.groupBy("doc_id", "segment_id").agg(F.count("*").alias("n_elements"), F.sum("tokens").alias("token_count"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by the count of characters, in all and of the longest paragraph."""
    tokens = COUNTERS["chars4"](F.col("content"))
    return paragraphs(spark, sf_dir).groupBy("doc_id").agg(F.sum(tokens).alias("tokens"), F.max(tokens).alias("most"))


def pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the public byte-pair pattern, a lower bound of its tokens; SQL engines lack its look-ahead."""
    return paragraphs(spark, sf_dir).groupBy("doc_id").agg(F.sum(COUNTERS["pretoken"](F.col("content"))).alias("pretokens"))


def folded(source: str, rule: str) -> str:
    """CTEs that number the segments of `source` (headed, with tokens) row by row."""
    head, over = "coalesce(e.lvl, 9) <= 2", f"f.held + e.tokens > {MOST}"
    cut = f"f.held >= {LEAST} AND ({head} OR {over})" if rule == "rich" else f"{over} OR (f.held >= {LEAST} AND {head})"
    return f"""
toks AS (SELECT *, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM {source}),
fold AS (
  SELECT doc_id, seq, tokens AS held, {int(rule == "rich")} AS segment_id FROM toks WHERE seq = 0
  UNION ALL
  SELECT e.doc_id, e.seq, CASE WHEN {cut} THEN e.tokens ELSE f.held + e.tokens END, CASE WHEN {cut} THEN f.segment_id + 1 ELSE f.segment_id END
  FROM fold f JOIN toks e ON e.doc_id = f.doc_id AND e.seq = f.seq + 1
), cut_up AS (SELECT t.*, f.segment_id FROM toks t JOIN fold f USING (doc_id, seq))
"""


RICH = f"WITH RECURSIVE {PARAGRAPHS}, {heads_sql('para', HEADING_LEVEL)}, {folded('headed', 'rich')}"
_sound = f"sound AS (SELECT *, {HEADING_LEVEL} AS lvl, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS place FROM para WHERE seq % 5 <> 3)"
FAULTY = f"WITH RECURSIVE {PARAGRAPHS}, {_sound}, dealt AS (SELECT * EXCLUDE (seq, place), place AS seq, seq AS own FROM sound), {folded('dealt', 'rich')}".replace("SELECT t.*, f.segment_id FROM", "SELECT t.* EXCLUDE (seq, own), t.own AS seq, f.segment_id FROM")
_kept = KEPT.removeprefix("WITH ").replace("levelled AS", "levelled0 AS").replace("FROM levelled ", "FROM levelled0 ").replace("ran AS", "ran0 AS").replace("FROM ran)", "FROM ran0)").replace("headed AS", "headed0 AS").replace("FROM headed WHERE", "FROM headed0 WHERE")
_dense = "dense AS (SELECT doc_id, filtered_index AS seq, id, content, role, page_number FROM kept)"
FILTERED = f"WITH RECURSIVE {_kept}, {_dense}, {heads_sql('dense', HEADING_LEVEL)}, {folded('headed', 'filtered')}"
SUMS = "doc_id, segment_id, count(*) AS n_elements, CAST(sum(tokens) AS BIGINT) AS token_count, min(seq) AS first_seq, max(seq) AS last_seq"
LASTS = ", ".join(f"arg_max(struct_pack(x := h{k}), seq) AS l{k}" for k in range(1, 7))
FIRSTS = ", ".join(f"arg_min(struct_pack(x := h{k}), seq) AS f{k}" for k in range(1, 7))

QUERIES = {"segment_rich": segment_rich, "segment_filtered": segment_filtered, "segment_mappings": segment_mappings, "segment_summary": segment_summary, "segment_faulty": segment_faulty, "token_counts": token_counts, "pretoken_counts": pretoken_counts}
ORACLE_SQL = {
    "segment_rich": f"{RICH}, s AS (SELECT {SUMS}, {LASTS} FROM cut_up GROUP BY doc_id, segment_id) SELECT doc_id, segment_id, n_elements, token_count, first_seq, last_seq, {', '.join(f'l{k}.x AS h{k}' for k in range(1, 7))} FROM s",
    "segment_filtered": f"""{FILTERED}, s AS (SELECT {SUMS}, {LASTS}, {FIRSTS} FROM cut_up GROUP BY doc_id, segment_id),
n AS (SELECT *, {', '.join(f'coalesce(lead(f{k}) OVER w, l{k}) AS n{k}' for k in range(1, 7))} FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY segment_id))
SELECT doc_id, segment_id, n_elements, token_count, first_seq, last_seq, {', '.join(f'n{k}.x AS h{k}' for k in range(1, 7))} FROM n""",
    "segment_mappings": f"""{FILTERED}, m AS (SELECT doc_id, filtered_index, id AS element_id, coalesce(role, 'unknown') AS element_type, page_number, md5(content) AS content_hash FROM kept)
SELECT m.doc_id, c.segment_id, m.filtered_index, m.element_id, m.element_type, m.page_number, m.content_hash FROM m JOIN (SELECT DISTINCT doc_id, segment_id, id FROM cut_up) c ON c.doc_id = m.doc_id AND c.id = m.element_id""",
    "segment_summary": f"""{RICH}, s AS (SELECT doc_id, count(DISTINCT segment_id) AS segments, CAST(sum(tokens) AS BIGINT) AS tokens, count(DISTINCT page_number) AS pages FROM cut_up GROUP BY doc_id)
SELECT *, round(tokens / segments, 6) AS tokens_per_segment FROM s""",
    "segment_faulty": f"""{FAULTY} SELECT {SUMS} FROM cut_up GROUP BY doc_id, segment_id""",
    "token_counts": f"WITH {PARAGRAPHS} SELECT doc_id, CAST(sum(ceil(length(content) / 4.0)) AS BIGINT) AS tokens, CAST(max(ceil(length(content) / 4.0)) AS BIGINT) AS most FROM para GROUP BY doc_id",
}
