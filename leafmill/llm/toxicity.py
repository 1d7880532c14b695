"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Examples are a bounded sample: at most `per_class` labelled texts of each class, `max_words` words in a row of each from a
place chosen by hash. Terms are the sample's words whose class association is significant (chi-squared of one degree of
freedom, level `alpha` divided by the number of words tested), so that the many words of one text or topic do not vote.
Inverse document frequencies are counted over all documents. A text's vector has (1 + ln tf) * ln((1 + N) / df) for each
term, at length 1; whole texts are read.

The index has for each term its postings by example, in blocks of `BLOCK` examples, and the largest weight in each block.
A query sums block maxima into an upper bound for each block. It scores the most promising blocks first, and then every block
whose bound reaches the k-th best similarity so far: no example that could be among the k nearest is passed over, so the
result equals a scan of all examples. Ties go to the lower example number.

Neighbours vote by similarity; a vote also counts by its class's share of labelled documents over that of the sample, so
a class that was sampled more does not count more. The share of toxic votes becomes a probability by isotonic regression
over the sample itself, each example voted on by the others (pool adjacent violators). A text without a term has no
neighbour; its score is the toxic share among such examples. Evidence: the neighbours' ids, similarities and labels.

The index is at most 2 * per_class * max_words postings and is sent to all tasks; document frequencies are counted in the
tasks, so at most a row for each term and task is shuffled.

Defined results: null and empty texts are texts without a term; with no labels, or labels of one class, every score is
that class's share (0.5 for none); rows that repeat are scored alike; of rows that repeat a doc_id one is learned from; a
null doc_id is never learned from and counts as held out; doc_id may have any type; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.langid import held_out, split_texts
from leafmill.llm.samples import one_per_bucket
from leafmill.session import resident, small_arrow_batches

TERM = re.compile(r"\w+")
BLOCK = 64
SLACK = 1e-9  # of sums of floating-point numbers


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").lower())


def significant(texts: list[Counter], labels: np.ndarray, alpha: float) -> list[str]:
    """The words of the texts whose presence goes with one class, at level alpha over all words together; sorted."""
    with_term = {y: Counter(w for t, v in zip(texts, labels, strict=True) if v == y for w in t) for y in (0, 1)}
    n = {y: int((labels == y).sum()) for y in (0, 1)}
    words = sorted(with_term[0] | with_term[1])
    if not words or not min(n.values()):
        return []
    a = np.array([with_term[1][w] for w in words], dtype=float)
    b = np.array([with_term[0][w] for w in words], dtype=float)
    c, d, total = n[1] - a, n[0] - b, n[0] + n[1]
    odds = (a + b) * (c + d) * (a + c) * (b + d)
    chi = total * (a * d - b * c) ** 2 / np.where(odds > 0, odds, 1)
    limit = NormalDist().inv_cdf(alpha / len(words) / 2) ** 2
    return [w for w, x, o in zip(words, chi, odds, strict=True) if o > 0 and x >= limit]


@dataclass
class Index:
    """Postings sorted by term and example; term t's of block b are at `places[t, b]` to `places[t, b + 1]`."""

    terms: dict[str, int]
    idf: np.ndarray
    n: int = 0  # examples
    places: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    maxima: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text, in order, and their weights at length 1."""
        held = sorted((self.terms[w], n) for w, n in counts.items() if w in self.terms)
        t = np.array([x for x, _ in held], dtype=np.int64)
        w = (1 + np.log(np.array([n for _, n in held], dtype=float))) * self.idf[t]
        length = math.sqrt(float((w * w).sum()))
        return (t, w / length) if length > 0 else (t[:0], w[:0])

    def fill(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Index the examples."""
        self.n = len(vectors)
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        order = np.lexsort((owner, term))
        self.example, self.weight = owner[order], np.concatenate([w for _, w in vectors] or [np.zeros(0)])[order]
        blocks = -(-self.n // BLOCK)
        cells = term[order] * (blocks + 1) + self.example // BLOCK
        self.places = np.searchsorted(cells, np.arange(len(self.terms) * (blocks + 1))).reshape(len(self.terms), blocks + 1)
        self.maxima = np.zeros((len(self.terms), blocks))
        np.maximum.at(self.maxima, (term[order], self.example // BLOCK), self.weight)

    def scores(self, t: np.ndarray, w: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All examples of the blocks (in order) and their cosines; a cosine is summed by term, whatever the blocks."""
        low, high = self.places[t][:, blocks].ravel(), self.places[t][:, blocks + 1].ravel()
        sizes = high - low
        at = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        q = np.repeat(np.repeat(w, len(blocks)), sizes)
        sums = np.bincount(self.example[at], weights=q * self.weight[at], minlength=self.n)
        ids = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        ids = ids[ids < self.n]
        return ids, sums[ids]

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples with a positive cosine, without example `but`, and their cosines, best first."""
        if not len(t) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        bounds = w @ self.maxima[t]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        first = order[: max(1, -(-2 * k // BLOCK))]
        ids, found = self.scores(t, w, first)
        found = np.where(ids == but, -1, found)
        floor = np.partition(found, -k)[-k] if len(found) >= k else 0.0
        more = order[len(first) :]
        more = more[bounds[more] >= floor - SLACK]
        if len(more):
            ids_more, found_more = self.scores(t, w, more)
            ids, found = np.concatenate((ids, ids_more)), np.concatenate((found, np.where(ids_more == but, -1, found_more)))
        keep = found > 0
        ids, found = ids[keep], found[keep]
        best = np.lexsort((ids, -found))[:k]
        return ids[best], found[best]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function nearest to y by weighted squares: (least x, value) of each step."""
    levels, back = np.unique(x, return_inverse=True)
    w = np.bincount(back, weights=weight)
    v = np.bincount(back, weights=weight * y) / w
    pools: list[list[float]] = []  # least x, value, weight
    for a, b, c in zip(levels.tolist(), v.tolist(), w.tolist(), strict=True):
        pools.append([a, b, c])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            _, b1, c1 = pools.pop()
            p = pools[-1]
            p[1], p[2] = (p[1] * p[2] + b1 * c1) / (p[2] + c1), p[2] + c1
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


@dataclass
class Model:
    """The examples, their index, and how votes become scores; `constant` is every score if nothing could be learned."""

    constant: float | None = None
    index: Index | None = None
    ids: list[str] = field(default_factory=list)
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    counts_for: np.ndarray = field(default_factory=lambda: np.ones(2))  # of a vote, by class
    k: int = 15
    alone: float = 0.0
    steps: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def share(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """The toxic share of the votes."""
        y = self.labels[found]
        votes = cosines * self.counts_for[y]
        return float((votes * y).sum() / votes.sum())

    def score(self, text: str | None) -> tuple[float, np.ndarray, np.ndarray]:
        """The text's score, nearest examples and their cosines."""
        none = np.zeros(0, np.int64), np.zeros(0)
        if self.constant is not None:
            return self.constant, *none
        known = self.index.terms
        found, cosines = self.index.nearest(*self.index.vector(Counter(w for w in terms(text) if w in known)), self.k)
        if not len(found):
            return self.alone, *none
        return float(self.levels[max(0, np.searchsorted(self.steps, self.share(found, cosines), "right") - 1)]), found, cosines


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[int, np.ndarray]:
    """The number of all documents, and of those with each word."""
    sent, key = docs.sparkSession.sparkContext.broadcast(words), uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = resident(("terms", key), lambda: {w: i for i, w in enumerate(sent.value)})
        known, df = number.keys(), np.zeros(len(number) + 1, dtype=np.int64)
        for b in batches:
            df[-1] += b.num_rows
            for t in b.column("text").to_pylist():
                for w in known & set(terms(t)):
                    df[number[w]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df))), pa.array(df)], names=["term", "n"])

    counts = {r["term"]: r["n"] for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return counts.get(len(words), 0), np.array([counts.get(i, 0) for i in range(len(words))], dtype=float)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2000, max_words: int = 2000, k: int = 15, alpha: float = 0.01
) -> Model:
    """Learn from the labelled rows among docs: labels has doc_id and a column of 0 and 1."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").distinct()
    in_all = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}

    def piece(doc_id: object, text: str | None) -> str:
        cut = terms(text)
        begin = crc32(str(doc_id).encode()) * 2654435761 % (max(0, len(cut) - max_words) + 1)
        return " ".join(cut[begin : begin + max_words])

    rows = one_per_bucket(docs.select("doc_id", "text"), known, per_class, piece, ["doc_id"])
    y = np.array([r["label"] for r in rows], dtype=np.int64)
    if len(np.unique(y)) < 2:
        return Model(constant=float(y[0]) if len(y) else 0.5)
    texts = [Counter(terms(r["text"])) for r in rows]
    words = significant(texts, y, alpha)
    n, df = document_frequencies(docs, words)
    index = Index({w: i for i, w in enumerate(words)}, np.log((1 + n) / np.maximum(df, 1)))
    vectors = [index.vector(t) for t in texts]
    index.fill(vectors)
    counts_for = np.array([in_all[c] / (y == c).sum() for c in (0, 1)])
    model = Model(None, index, [str(r["doc_id"]) for r in rows], y, counts_for / counts_for.max(), k)
    near = [index.nearest(*v, k, but=i) for i, v in enumerate(vectors)]
    voted = np.array([len(found) > 0 for found, _ in near])
    weight = model.counts_for[y]
    prior = float((weight * y).sum() / weight.sum())
    model.alone = float(((weight * y)[~voted].sum() + prior) / (weight[~voted].sum() + 1))
    shares = np.array([model.share(*x) if len(x[0]) else 0.0 for x in near])
    if voted.any():
        model.steps, model.levels = isotonic(shares[voted], y[voted].astype(float), weight[voted])
    else:
        model.steps, model.levels = np.zeros(1), np.array([prior])
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, evidence: int = 3) -> DataFrame:
    """doc_id, score, predicted and evidence (of the nearest examples doc_id, similarity and label) of each row."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    narrow = docs.select("doc_id", "text")
    proof = pa.list_(pa.struct([("doc_id", pa.string()), ("similarity", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for at, texts in split_texts(b.column("text").to_pylist()):
                done = [m.score(t) for t in texts]
                shown = [[{"doc_id": m.ids[i], "similarity": c, "label": int(m.labels[i])} for i, c in zip(f[:evidence].tolist(), s[:evidence].tolist(), strict=True)] for _, f, s in done]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), pa.array([x for x, _, _ in done], pa.float64()), pa.array(shown, proof)], names=["doc_id", "score", "evidence"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    found = narrow.mapInArrow(run, f"doc_id {kind}, score double, evidence array<struct<doc_id: string, similarity: double, label: int>>")
    return found.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 4, 2))
    done = score(docs, fit(docs, labels))
    nearest = F.transform("evidence", lambda e: e["doc_id"]).alias("nearest")
    return done.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted", nearest)
