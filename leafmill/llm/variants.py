"""Spelling variants by full neighbourhood generation: all texts at one edit from a word are made and looked up.

Words are runs of letters, counted per shard and merged by key. A vocabulary word's neighbourhood is every distinct text
that one deletion, replacement or insertion makes of it, over the letters that the vocabulary has. What of it is in the
vocabulary is at a distance of exactly one, so the lookup is a hash join on the texts and no distance is computed.

A word of 12 letters has about 2,200 such texts over 90 letters. They are first made as polynomial hashes by array
arithmetic (prefix, new letter, suffix) and tested against a bitmap of the vocabulary of fixed size; only those that may
be words become text and are shuffled to the join. The bitmap loses none; the join settles what it lets through. A word is
looked up by at most its own neighbourhood, so no key of the join is hot.

A word's form is its near word of the largest count (ties: smallest in code-point order), if that is at least `ratio` times
the word's own. Counts grow along forms, so chains end; roots are found by doubling steps (each round joins what is open
with itself), with a checkpoint between rounds.

Runs are `[A-Za-z\\u00C0-\\u00FF]+`, A-Z alone in lower case. `changed` is applied to runs before they are counted: with
h = crc32("<doc_id>:<run>"), a run whose h is divisible by 199 loses its code point h % length, as if mistyped.

Defined results: null text has no runs; a null doc_id reads as empty text; rows that repeat count each time; texts of any
length are read whole; words of fewer than `min_length` code points or `min_count` occurrences are no words; an empty
table gives no row; other columns are ignored; doc_id may have any type.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bitmap
from leafmill.llm.collocations import LOWER, dictionary, spans
from leafmill.session import checkpoint_dir, few, small_arrow_batches

RARE = 199
BASE = np.uint64(0x9E3779B97F4A7C15)
SMALL = np.isin(np.arange(256), np.arange(ord("a"), ord("z") + 1))
AT_ONCE = 1 << 20  # neighbours in memory
STEPPED = 48  # bytes of a run whose checksum is computed together with others'


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), c >> np.uint32(1) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


CRC = _crc_table()


def runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of the texts' runs of letters: their text's number, index among the distinct ones, and those."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw).translate(LOWER), dtype=np.uint8)
    lead = data == 0xC3  # U+00C0 to U+00FF are this byte and the next
    inside = SMALL[data] | lead
    inside[1:] |= lead[:-1]
    begins, ends = spans(inside)
    indices, distinct = dictionary(data, inside, begins, ends)
    starts = np.cumsum([0, *(len(x) + 1 for x in raw[:-1])])
    return np.searchsorted(starts, begins, "right") - 1, indices.astype(np.int64), distinct


def checksums(prefixes: np.ndarray, distinct: pa.Array, which: np.ndarray) -> np.ndarray:
    """crc32 of what has the given checksums followed by the chosen texts."""
    offsets = np.frombuffer(distinct.buffers()[1], dtype=np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    data = np.frombuffer(distinct.buffers()[2] or b"", dtype=np.uint8)
    size, start = np.diff(offsets)[which], offsets[:-1][which]
    order = np.argsort(-size, kind="stable")
    out = np.empty(len(which), dtype=np.uint32)
    long = int(np.searchsorted(-size[order], -STEPPED))  # so many are over STEPPED bytes or have just as many
    for i in order[:long].tolist():
        out[i] = crc32(data[start[i] : start[i] + size[i]].tobytes(), int(prefixes[i]))
    rest = order[long:]
    state, at, left = prefixes[rest] ^ np.uint32(0xFFFFFFFF), start[rest], size[rest]
    for j in range(int(left[0]) if len(rest) else 0):
        n = int(np.searchsorted(-left, -j))  # those longer than j stand first
        state[:n] = CRC[(state[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ state[:n] >> np.uint32(8)
    out[rest] = state ^ np.uint32(0xFFFFFFFF)
    return out


def counted(doc_ids: list[str | None], texts: list[str | None]) -> tuple[pa.Array, np.ndarray, Counter]:
    """Distinct runs of the texts, how often each is counted as it stands, and what the others became."""
    of_text, index, distinct = runs(texts)
    pairs, times = np.unique(of_text * max(1, len(distinct)) + index, return_counts=True)
    text, index = pairs // max(1, len(distinct)), pairs % max(1, len(distinct))
    prefixes = np.fromiter((crc32(f"{'' if d is None else d}:".encode()) for d in doc_ids), dtype=np.uint32, count=len(doc_ids))
    h = checksums(prefixes[text], distinct, index)
    hit = h % RARE == 0
    n = np.bincount(index[~hit], weights=times[~hit], minlength=len(distinct)).astype(np.int64)
    typed: Counter = Counter()
    for i, k, c in zip(index[hit].tolist(), h[hit].tolist(), times[hit].tolist(), strict=True):
        word = distinct[i].as_py()
        cut = k % len(word)
        typed[word[:cut] + word[cut + 1 :]] += c
    return distinct, n, typed


def vocabulary(docs: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """word and n of the words that occur often enough, changed runs included."""
    small_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            distinct, n, typed = counted(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
            long = (pc.utf8_length(distinct).to_numpy(zero_copy_only=False) >= min_length) & (n > 0)
            yield pa.RecordBatch.from_arrays([distinct.filter(pa.array(long)).cast(pa.string()), pa.array(n[long])], names=["word", "n"])
            some = [(w, c) for w, c in typed.items() if len(w) >= min_length]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([c for _, c in some], pa.int64())], names=["word", "n"])

    narrow = docs.select(F.col("doc_id").cast("string"), "text")
    counts = narrow.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


def values(points: np.ndarray) -> np.ndarray:
    """A random value of each code point."""
    return bitmap.mixed(points.astype(np.uint64) * BASE + np.uint64(1))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of words, their code points as a matrix) for each length."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for size in np.unique(lengths).tolist():
        some = np.nonzero(lengths == size)[0]
        joined = "".join(words[i] for i in some.tolist()).encode("utf-32-le", "surrogatepass")
        yield some, np.frombuffer(joined, dtype="<u4").reshape(len(some), size)


def hashes(words: list[str]) -> np.ndarray:
    """What the bitmap knows each word by: the polynomial of its code points' values, mixed with its length."""
    out = np.zeros(len(words), dtype=np.uint64)
    for some, points in by_length(words):
        h = np.zeros(len(some), dtype=np.uint64)
        for j in range(points.shape[1]):
            h = h * BASE + values(points[:, j])
        out[some] = bitmap.mixed(h + np.uint64(points.shape[1]))
    return out


def neighbours(words: list[str], letters: str, bits: np.ndarray, least: int) -> Iterator[tuple[int, str]]:
    """(number of the word, text) for each distinct text at one edit, of `least` code points or more, that the bitmap may hold."""
    new = np.frombuffer(letters.encode("utf-32-le"), dtype="<u4")
    for some, points in by_length(words):
        size = points.shape[1]
        power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size + 1, BASE))))
        block = max(1, AT_ONCE // ((size + 1) * max(1, len(new))))
        for b in range(0, len(some), block):
            own = points[b : b + block]
            prefix = np.zeros((len(own), size + 1), dtype=np.uint64)
            suffix = np.zeros((len(own), size + 1), dtype=np.uint64)
            for j in range(size):
                prefix[:, j + 1] = prefix[:, j] * BASE + values(own[:, j])
                suffix[:, size - 1 - j] = suffix[:, size - j] + values(own[:, size - 1 - j]) * power[j]
            again = np.zeros((len(own), size + 1), dtype=bool)
            again[:, 1:size] = own[:, 1:] == own[:, :-1]
            edits = []
            if size - 1 >= least:  # of equal letters in a row, the first is deleted
                edits.append((0, 1, prefix[:, :size] * power[size - 1 :: -1][:size] + suffix[:, 1:], ~again[:, :size]))
            if size >= least:
                made = (prefix[:, :size] * power[size:0:-1] + suffix[:, 1:])[:, :, None] + values(new) * power[size - 1 :: -1][:size, None]
                edits.append((1, 1, made, own[:, :, None] != new))
            if size + 1 >= least:  # a letter is not inserted behind an equal one, but before it
                made = (prefix * power[size + 1 : 0 : -1] + suffix)[:, :, None] + values(new) * power[size::-1][: size + 1, None]
                other = np.ones((len(own), size + 1, len(new)), dtype=bool)
                other[:, 1:] = own[:, :, None] != new
                edits.append((1, 0, made, other))
            for adds, takes, made, ok in edits:
                length = np.uint64(size + adds - takes)
                at = np.nonzero(ok.ravel())[0]
                at = at[bitmap.holds(bits, bitmap.mixed(made.ravel()[at] + length))]
                for where in zip(*np.unravel_index(at, made.shape), strict=True):
                    i, j = int(some[b + where[0]]), int(where[1])
                    yield i, words[i][:j] + (letters[where[2]] if adds else "") + words[i][j + takes :]


def near_words(words: DataFrame, min_length: int = 6) -> DataFrame:
    """word, n, near and near_n: each pair of vocabulary words (word, n) at one edit, from both sides."""
    spark = words.sparkSession
    small_arrow_batches(spark)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hashes(b.column("word").to_pylist()).view(np.int64))], names=["h"])

    letters = "".join(sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()))
    sent = spark.sparkContext.broadcast(bitmap.of(words.select("word").mapInArrow(hashed, "h long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, n = b.column("word").to_pylist(), b.column("n").to_numpy()
            which, texts = [], []
            for i, text in neighbours(held, letters, sent.value, min_length):
                which.append(i)
                texts.append(text)
            at = np.array(which, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("word").take(pa.array(at)), pa.array(n[at]), pa.array(texts, pa.string())], names=["word", "n", "near"])

    made = words.select("word", "n").mapInArrow(run, "word string, n long, near string")
    return made.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def roots(forms: DataFrame) -> DataFrame:
    """word and root for each row (word, form): where the forms end."""
    step = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        open_rows = step.join(few(onward), "root", "left").checkpoint()
        step = open_rows.select("word", F.coalesce("next", "root").alias("root")).checkpoint()
        if not open_rows.where("next is not null").limit(1).count():
            return step


def variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word. docs has doc_id and text."""
    checkpoint_dir(docs.sparkSession)
    words = vocabulary(docs, min_length, min_count).checkpoint()
    dealt = words.repartition(words.sparkSession.sparkContext.defaultParallelism * 4, "word")
    best = F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near"))).alias("best")
    near = near_words(dealt, min_length).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    form = -F.col("best.least") >= ratio * F.col("n")
    near = near.select("word", "n_near", F.when(form, F.col("best.near")).alias("form"), F.when(form, -F.col("best.least")).alias("form_n")).checkpoint()
    ends = roots(near.where("form is not null").select("word", "form"))
    found = words.join(near, "word", "left").join(ends, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
