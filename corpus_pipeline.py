"""Corpus pipeline: language, repeated lines, near-duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents, under any names.

Defined results of every stage: an empty table stays empty; repeated rows are treated alike (of near-duplicates, repeats
included, one row stays); null texts have no language and go in the first stage, but pass the others as texts without
words; null doc_ids come last where the smallest stays; texts of any length are read whole.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, langid, similar, templates, tiling
from leafmill.session import checkpoint_dir, quoted, table

#: No SQL can express the trained language model; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; learned from those of them that are not held out."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"), 3, 1)))
    return langid.keep_known(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of templates that other documents have first; n_chars follows the text."""
    done = templates.dedup_lines(docs, share=0.5, counts=None)
    return done.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else quoted(c) for c in docs.columns])


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, 0.8 similar by shingles of five words: SimHash, then exactly beyond its radius."""
    return similar.keep_one_of_similar(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what stands between them is written below the shared folder."""
    docs = table(spark, sf_dir, "documents")
    top = f"{checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{top}/{k}-{name}")
            docs = spark.read.parquet(f"{top}/{k}-{name}")
    return docs
