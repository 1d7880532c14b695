"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of 64 words. Each passage is encoded from its hashed words, its bytes and its repetition;
a learned layer makes an embedding of it, gated attention (tanh times sigmoid) a weight, and the document's score is a
logistic function of the weighted sum of its passages' embeddings. Labels are of documents only; attention learns which
passages decide.

Training takes a bounded sample (at most `per_class` labelled rows of each class, one of each doc_id, `max_passages` passages
in a row from a place chosen by hash) to the driver. The model has a fixed size and is sent to all tasks; whole texts are scored where they are
read, and nothing is shuffled.

Defined results: null and empty texts are a bag of one empty passage and get that bag's score; with no labels, or labels
of one class, every score is that class's share (0.5 for none); repeated rows are scored alike; documents with several
labels are learned with each; a null doc_id is never learned from and counts as held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.langid import held_out, split_texts
from leafmill.llm.samples import one_per_bucket
from leafmill.session import small_arrow_batches

PASSAGE = 64
WORDS = 512
WIDTH = WORDS + 256 + 4
EMBEDDING, ATTENTION = 24, 12


class Buckets(dict):
    """Hash buckets of words; emptied when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        b = self[word] = crc32(word.lower().encode("utf-8", "replace")) % WORDS
        return b


def passages(text: str | None) -> list[list[str]]:
    cut = (text or "").split()
    return [cut[i : i + PASSAGE] for i in range(0, max(1, len(cut)), PASSAGE)]


def inputs(bag: list[list[str]], buckets: Buckets) -> np.ndarray:
    """The features of passages, one row each."""
    n = len(bag)
    sizes = np.fromiter(map(len, bag), dtype=np.int64, count=n)
    ids = np.fromiter(map(buckets.__getitem__, chain.from_iterable(bag)), dtype=np.int64, count=int(sizes.sum()))
    by_word = np.bincount(np.repeat(np.arange(n), sizes) * WORDS + ids, minlength=n * WORDS).reshape(n, WORDS)
    joined = [" ".join(p).encode("utf-8", "replace") for p in bag]
    lengths = np.fromiter(map(len, joined), dtype=np.int64, count=n)
    raw = np.frombuffer(b"".join(joined), dtype=np.uint8)
    by_byte = np.bincount(np.repeat(np.arange(n), lengths) * 256 + raw, minlength=n * 256).reshape(n, 256)
    distinct = np.fromiter((len(set(p)) for p in bag), dtype=np.float64, count=n)
    some = np.maximum(sizes, 1)
    owner = np.repeat(np.arange(n), sizes)
    again = np.bincount(owner[1:][(ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
    rest = np.stack([distinct / some, again / some, np.minimum(4, lengths / some / 8), sizes / PASSAGE], axis=1)
    return np.concatenate([np.sqrt(by_word / some[:, None]), np.sqrt(by_byte / np.maximum(lengths, 1)[:, None]), rest], axis=1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights; `constant` is the score of everything if nothing could be learned."""

    constant: float | None = None
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, x: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w, of = self.weights, np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        v, u = np.tanh(h @ w["tanh"]), sigmoid(h @ w["gate"])
        e = (v * u) @ w["attend"]
        a = np.exp(e - np.maximum.reduceat(e, begins)[of])
        a /= np.add.reduceat(a, begins)[of]
        z = np.add.reduceat(a[:, None] * h, begins, axis=0)
        return {"of": of, "h": h, "v": v, "u": u, "a": a, "z": z, "score": sigmoid(z @ w["out"] + w["out_bias"][0])}

    def scores(self, texts: list[str | None], buckets: Buckets) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        bags = [passages(t) for t in texts]
        counts = np.fromiter(map(len, bags), dtype=np.int64, count=len(bags))
        return self.forward(inputs(list(chain.from_iterable(bags)), buckets), np.cumsum(counts) - counts, counts)["score"].astype(float).tolist()


def gradient(model: Model, x: np.ndarray, begins: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss of documents, by weight."""
    w, f = model.weights, model.forward(x, begins, counts)
    of, h, v, u, a = (f[k] for k in ("of", "h", "v", "u", "a"))
    ds = (f["score"] - y) / len(y)
    dz = (ds[:, None] * w["out"])[of]
    da = (h * dz).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, begins)[of])
    dvu = de[:, None] * w["attend"]
    dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
    dh = (a[:, None] * dz + dv @ w["tanh"].T + du @ w["gate"].T) * (1 - h * h)
    return {"encode": x.T @ dh, "encode_bias": dh.sum(axis=0), "tanh": h.T @ dv, "gate": h.T @ du, "attend": (v * u).T @ de, "out": f["z"].T @ ds, "out_bias": np.array([ds.sum()])}


def train(texts: list[str], labels: list[int], epochs: int = 12, batch: int = 32, seed: int = 11) -> Model:
    """Adam on the log loss."""
    if len(set(labels)) < 2:
        return Model(constant=float(labels[0]) if labels else 0.5)
    rng, buckets = np.random.default_rng(seed), Buckets()
    model = Model()
    for name, shape in (("encode", (WIDTH, EMBEDDING)), ("encode_bias", (EMBEDDING,)), ("tanh", (EMBEDDING, ATTENTION)), ("gate", (EMBEDDING, ATTENTION)), ("attend", (ATTENTION,)), ("out", (EMBEDDING,)), ("out_bias", (1,))):
        model.weights[name] = np.zeros(shape) if "bias" in name else rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    bags = [inputs(passages(t), buckets) for t in texts]
    y = np.array(labels, dtype=np.float64)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            counts = np.array([len(bags[k]) for k in some])
            g = gradient(model, np.concatenate([bags[k] for k in some]), np.cumsum(counts) - counts, counts, y[some])
            step += 1
            for k, d in g.items():
                d = d + 1e-5 * model.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                model.weights[k] -= 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model.weights = {k: v.astype(np.float32) for k, v in model.weights.items()}
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1200, max_passages: int = 48) -> Model:
    """Learn from the labelled rows among docs: labels has doc_id and a column of 0 and 1."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1)")

    def piece(doc_id: object, text: str | None) -> str:
        bag = passages(text)
        begin = crc32(str(doc_id).encode()) * 2654435761 % (max(0, len(bag) - max_passages) + 1)
        return " ".join(chain.from_iterable(bag[begin : begin + max_passages]))

    rows = one_per_bucket(docs.select("doc_id", "text"), known, per_class, piece, ["doc_id"])
    found = sorted(rows, key=lambda r: (r["doc_id"], r["label"], r["text"]))
    return train([r["text"] for r in found], [r["label"] for r in found])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of each row."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    narrow = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for b in batches:
            for at, texts in split_texts(b.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), pa.array(sent.value.scores(texts, buckets), pa.float64())], names=["doc_id", "score"])

    found = narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 5, 0))
    done = score(docs, fit(docs, labels))
    return done.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
