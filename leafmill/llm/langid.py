"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters, in lower case. A word's score for each language is a learned sum over hashed features: the
word itself (lexicon), its character n-grams, and those at its begin and end (affixes). Learned transitions join
neighbouring words, so text that switches between languages is labelled word by word; forward-backward gives each
word's posterior. A document gets the language of the largest sum of posteriors; its score is their mean.

Training takes a bounded sample of labelled rows (`per_language` rows of each language, `max_words` words in a row from a
place chosen by hash) to the driver. Pieces of documents in different languages are spliced into training sequences, as
labels are of whole documents and would show no switch. The weights have a fixed size and are sent to all tasks.

Chains of any length are computed in blocks: each block's transfer matrices are multiplied first, blocks are joined in
order, then all blocks run forward and backward at once; nothing is cut off.

Defined results: null text, or text without a letter, is `und` with score 0; so is every text if no row has a label.
Ties go to the first language by name. Repeated rows are scored alike; a null doc_id is never learned from and counts as
held out. Languages of any number are learned; other columns are ignored, and pass through `keep_known`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.samples import one_per_bucket
from leafmill.session import map_rows, resident, small_arrow_batches

WORD = regex.compile(r"\p{L}+")
BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
BLOCK = 64
KNOWN_WORDS = 200_000
WORDS_AT_ONCE = 4_096
UNKNOWN = "und"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of distinct words, one after another, and where each word's begin."""
    marked = [f"^{w}$" for w in vocabulary]
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(points))  # characters up to the word's end
    found, owners = [], []
    h = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 2):  # marked ends make an n-gram an affix of n - 1 characters
        shifted = np.zeros(len(points), dtype=np.uint64)
        shifted[: len(points) - n + 1] = points[n - 1 :]
        h = (h * np.uint64(1_000_003) + shifted + np.uint64(n)) & np.uint64(0xFFFFFFFFFFFF)
        ok = left >= n
        if n > max(ORDERS):  # longest affixes only
            first = np.ones(len(points), dtype=bool)
            first[1:] = owner[1:] != owner[:-1]
            ok &= first | (left == n)
        mixed = h * np.uint64(0x9E3779B97F4A7C15)
        found.append((mixed[ok] >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owners.append(owner[ok])
    first_point = points * np.uint64(31)
    whole = np.zeros(len(marked), dtype=np.uint64)
    place = (np.arange(len(points)) - np.repeat(ends - sizes, sizes)).astype(np.uint64)
    np.add.at(whole, owner, (first_point + np.uint64(7)) * (place * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)) ** np.uint64(2))
    found.append(((whole * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(41)).astype(np.int64) % BUCKETS)
    owners.append(np.arange(len(marked)))
    all_owners, all_found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(all_owners, kind="stable")
    counts = np.bincount(all_owners, minlength=len(marked))
    return all_found[order], np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    transitions: np.ndarray  # from x to
    start: np.ndarray

    def emissions(self, vocabulary: list[str]) -> np.ndarray:
        """Scores of distinct words for each language."""
        if not vocabulary:
            return np.zeros((0, len(self.languages)), dtype=np.float32)
        out = np.empty((len(vocabulary), len(self.languages)), dtype=np.float32)
        for at in range(0, len(vocabulary), WORDS_AT_ONCE):  # features of few words at once: memory stays small
            index, begins = features(vocabulary[at : at + WORDS_AT_ONCE])
            out[at : at + WORDS_AT_ONCE] = self.bias + np.add.reduceat(self.weights[index], begins, axis=0)
        return out


def posteriors(model: Model, scores: np.ndarray, lengths: list[int]) -> np.ndarray:
    """P(language of word | its document) for documents laid end to end, none of length 0."""
    k, total = scores.shape[1], len(scores)
    t = np.exp(model.transitions - model.transitions.max()).astype(np.float64)
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    n = np.asarray(lengths, dtype=np.int64)
    blocks = -(-n // BLOCK)
    doc_of = np.repeat(np.arange(len(n)), blocks)
    in_doc = np.arange(len(doc_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begins = np.repeat(np.cumsum(n) - n, blocks) + in_doc * BLOCK
    sizes = np.minimum(BLOCK, np.repeat(n, blocks) - in_doc * BLOCK)
    b = len(begins)
    step = np.arange(BLOCK)
    valid = step[None, :] < sizes[:, None]
    at = np.minimum(begins[:, None] + step[None, :], total - 1)
    x = np.where(valid[:, :, None], e[at], 1.0)  # blocks x steps x languages
    transfer = np.tile(np.eye(k), (b, 1, 1))
    for s in range(BLOCK):
        live = valid[:, s]
        after = (transfer[live] @ t) * x[live, s][:, None, :]
        transfer[live] = after / after.max(axis=(1, 2), keepdims=True)
    begin, last = np.zeros((b, k)), np.ones((b, k))
    start = np.exp(model.start - model.start.max())
    prior = np.linalg.solve(t.T, start) if np.linalg.cond(t) < 1e12 else start
    v = prior
    for i in range(b):  # few: a block is BLOCK words
        if in_doc[i] == 0:
            v = prior
        begin[i] = v
        v = v @ transfer[i]
        v = v / np.abs(v).max()
    for i in range(b - 1, -1, -1):
        if i == b - 1 or in_doc[i + 1] == 0:
            v = np.ones(k)
        last[i] = v
        v = transfer[i] @ v
        v = v / v.max()
    alpha, v = np.zeros((b, BLOCK, k)), begin
    for s in range(BLOCK):
        after = (v @ t) * x[:, s]
        after = np.maximum(after, 1e-300)
        v = np.where(valid[:, s][:, None], after / after.max(axis=1, keepdims=True), v)
        alpha[:, s] = v
    beta, v = np.zeros((b, BLOCK, k)), last
    for s in range(BLOCK - 1, -1, -1):
        beta[:, s] = v
        before = (v * x[:, s]) @ t.T
        v = np.where(valid[:, s][:, None], before / before.max(axis=1, keepdims=True), v)
    p = alpha * beta
    p /= p.sum(axis=2, keepdims=True)
    return p[valid]


class Labeller:
    """A model with the scores of words met so far."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)), dtype=np.float32)

    def words(self, cut: list[list[str]]) -> np.ndarray:
        """Posteriors of all words of some documents, end to end."""
        fresh = {w for c in cut for w in c}
        if len(self.known) + len(fresh) > KNOWN_WORDS:
            self.known, self.table = {}, self.table[:0]
        new = sorted(fresh - self.known.keys())
        self.known |= dict(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.table = np.concatenate([self.table, self.model.emissions(new)])
        of = self.known.__getitem__
        ids = np.concatenate([np.fromiter(map(of, c), dtype=np.int64, count=len(c)) for c in cut])
        return posteriors(self.model, self.table[ids], [len(c) for c in cut])

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and score of each text."""
        cut = [words(t) for t in texts]
        some = [k for k, c in enumerate(cut) if c]
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not self.model.languages or not some:
            return out
        lengths = [len(cut[k]) for k in some]
        p = self.words([cut[k] for k in some])
        means = np.add.reduceat(p, np.cumsum([0, *lengths[:-1]]), axis=0) / np.array(lengths)[:, None]
        for k, m in zip(some, means, strict=True):
            best = int(m.argmax())
            out[k] = (self.model.languages[best], min(1.0, max(0.0, float(m[best]))))
        return out


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """If crc32 of the id as text leaves this remainder; true for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def sample(docs: DataFrame, label: str, per_label: int, max_words: int) -> list[tuple[str, list[str]]]:
    """At most per_label texts of each label, as (label, up to max_words words in a row), chosen by hash of doc_id."""

    def piece(doc_id: object, text: str | None) -> str:
        cut = words(text)
        begin = crc32(str(doc_id).encode()) * 2654435761 % (max(0, len(cut) - max_words) + 1)
        return " ".join(cut[begin : begin + max_words])

    rows = docs.select("doc_id", F.col(label).cast("string").alias("label"), "text")
    found = one_per_bucket(rows, rows.select("doc_id", "label"), per_label, piece, ["doc_id", "label"])
    return [(r["label"], r["text"].split(" ")) for r in sorted(found, key=lambda r: (r["doc_id"], r["text"])) if r["text"]]


def spliced(texts: list[tuple[str, list[str]]], languages: list[str], length: int, rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """Training sequences: pieces of 4 to 40 words of the sample's texts, in random order, cut to equal lengths.

    The last one ends with the last word, and so overlaps the one before; fewer words than the length are one sequence.
    """
    number = {x: k for k, x in enumerate(languages)}
    parts = []
    for label, cut in texts:
        at = 0
        while at < len(cut):
            n = int(rng.integers(4, 41))
            parts.append((cut[at : at + n], number[label]))
            at += n
    rng.shuffle(parts)
    flat = [(w, y) for cut, y in parts for w in cut]
    begins = list(range(0, len(flat) - length + 1, length))
    if len(flat) % length:
        begins.append(max(0, len(flat) - length))
    return [([w for w, _ in flat[i : i + length]], [y for _, y in flat[i : i + length]]) for i in begins]


def fit(docs: DataFrame, label: str = "lang", per_language: int = 400, max_words: int = 300, epochs: int = 8, length: int = 48, seed: int = 7) -> Model:
    """Learn from the labelled rows of docs."""
    texts = sample(docs, label, per_language, max_words)
    languages = sorted({x for x, _ in texts})
    k = len(languages)
    rng = np.random.default_rng(seed)
    model = Model(languages, np.zeros((BUCKETS, k), dtype=np.float32), np.zeros(k), np.zeros((k, k)), np.zeros(k))
    sequences = spliced(texts, languages, length, rng) if k > 1 else []
    if not sequences:
        return model
    vocabulary = sorted({w for cut, _ in sequences for w in cut})
    number = {w: i for i, w in enumerate(vocabulary)}
    index, begins = features(vocabulary)
    counts = np.diff(np.concatenate([begins, [len(index)]]))
    x = np.array([[number[w] for w in cut] for cut, _ in sequences])
    y = np.array([labels for _, labels in sequences])
    squares = [np.full(a.shape, 1e-6) for a in (model.weights, model.bias, model.transitions, model.start)]
    batch = 64
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            xs, ys = x[order[at : at + batch]], y[order[at : at + batch]]
            used, local = np.unique(xs, return_inverse=True)
            local = local.reshape(xs.shape)
            pieces = np.concatenate([np.arange(begins[u], begins[u] + counts[u]) for u in used])
            own = index[pieces]
            owner = np.repeat(np.arange(len(used)), counts[used])
            table = model.bias + np.add.reduceat(model.weights[own], np.concatenate(([0], np.cumsum(counts[used])[:-1])), axis=0)
            g_table, g_trans, g_start = gradient(table, model.transitions, model.start, local, ys)
            rows, back = np.unique(own, return_inverse=True)
            g_rows = np.stack([np.bincount(back, weights=g_table[owner, j], minlength=len(rows)) for j in range(k)], axis=1) / len(xs) + 1e-6 * model.weights[rows]
            squares[0][rows] += g_rows**2
            model.weights[rows] -= (0.1 * g_rows / np.sqrt(squares[0][rows])).astype(np.float32)
            for a, s, g in ((model.bias, squares[1], g_table.sum(axis=0)), (model.transitions, squares[2], g_trans), (model.start, squares[3], g_start)):
                g = g / len(xs) + 1e-4 * a
                s += g**2
                a -= 0.1 * g / np.sqrt(s)
    return model


def gradient(table: np.ndarray, transitions: np.ndarray, start: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the negative log-likelihood of labelled sequences of equal length: by word scores, transitions and start."""
    n, length = x.shape
    k = table.shape[1]
    e = table[x]
    e = np.exp(e - e.max(axis=2, keepdims=True))
    t, s = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    alpha, beta = np.zeros((n, length, k)), np.ones((n, length, k))
    v = s * e[:, 0]
    alpha[:, 0] = v / v.sum(axis=1, keepdims=True)
    for i in range(1, length):
        v = (alpha[:, i - 1] @ t) * e[:, i]
        alpha[:, i] = v / v.sum(axis=1, keepdims=True)
    for i in range(length - 2, -1, -1):
        v = (beta[:, i + 1] * e[:, i + 1]) @ t.T
        beta[:, i] = v / v.sum(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=2, keepdims=True)
    joint = alpha[:, :-1, :, None] * t * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    g_trans = joint.sum(axis=(0, 1))
    np.subtract.at(g_trans, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    g_start = p[:, 0].sum(axis=0) - np.bincount(y[:, 0], minlength=k)
    np.put_along_axis(p, y[:, :, None], np.take_along_axis(p, y[:, :, None], 2) - 1, 2)
    g_table = np.stack([np.bincount(x.ravel(), weights=p[:, :, j].ravel(), minlength=len(table)) for j in range(k)], axis=1)
    return g_table, g_trans, g_start


def split_texts(texts: list[str | None], size: int = 1_500_000) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about so many characters, with the index of the first."""
    at = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= size or k == len(texts) - 1:
            yield at, texts[at : k + 1]
            at, held = k + 1, 0


def predict(docs: DataFrame, model: Model, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys, `lang_pred` and `score` of each row."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    sent, key = spark.sparkContext.broadcast(model), uuid4().hex  # BUCKETS x languages
    narrow = docs.select(*keys, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]), "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = resident(("langid", key), lambda: Labeller(sent.value))
        for b in batches:
            for at, texts in split_texts(b.column("__text").to_pylist()):
                found = labeller.documents(texts)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at, len(texts)) for k in keys), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*keys, "lang_pred", "score"])

    return narrow.mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model, margin: float = 1 / 15) -> DataFrame:
    """The rows of docs, with all columns, whose text has a language by a score well over that of a guess.

    A guess among k languages scores 1 / k; the score must be over it by `margin` of what is left to 1 (0.3 of four languages).
    A model that has learned no language rejects only texts without a letter.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    sent, key = spark.sparkContext.broadcast(model), uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = resident(("langid", key), lambda: Labeller(sent.value))
        guess = 1 / max(1, len(sent.value.languages))
        least = guess + margin * (1 - guess) - 1e-9
        for b in batches:
            for at, texts in split_texts(b.column("text").to_pylist()):
                found = labeller.documents(texts) if sent.value.languages else [("any", 1.0) if words(t) else (UNKNOWN, 0.0) for t in texts]
                keep = [x != UNKNOWN and s >= least for x, s in found]
                yield b.slice(at, len(texts)).filter(pa.array(keep, pa.bool_()))

    return map_rows(docs, run, "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"), 3, 1)))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
