"""Phrase collocations by word-id suffix arrays: built per shard by prefix doubling, their LCP intervals give n-gram counts.

A shard is a run of words of one Arrow batch. Words get ids from an exact dictionary of the batch, one for each (lang,
word); a boundary between pieces is id 0. Prefix doubling sorts the suffixes by their first `max_words` ids: ranks of
length k make those of length 2k by one sort of pairs. Suffixes that share at least m words stand together, so each
interval of the LCP array at depth m is a phrase of m words and its length is the phrase's count in the shard. A shard
ends after a fixed number of words; the next `max_words` - 1 words are seen but begin no suffix there.

Counts are merged globally by key, level by level. A phrase of m words that occurs `min_count` times consists of phrases
of m - 1 words that do. So the passes count hashes of words, then of pairs, and so on, and keep those of enough
occurrences in a bitmap of fixed size; a phrase goes on only if both parts of m - 1 words may be in it. The last pass
sends what is left of all lengths as text, so every count that is used is exact, whatever hashes collide: pruning only
ever lets too much through. What is shuffled are tasks' distinct phrases, summed before the shuffle, as hashes of HASH
bits until few are left; no word or phrase is a hot key.

A candidate is a phrase of 2 to `max_words` words with a = f(phrase) >= min_count. Cutting it after its first k words gives
l = f(first part), r = f(rest) and floor(1000000 * a * a / (l * r)), computed in decimals of 38 digits (exact for
a < 10^15); its score is the least over the cuts, of equal ones the smallest k. Candidates inside a longer one with
100 * f(longer) >= 50 * a are dropped. Of each lang the `top` best by (score, a, phrase) are ranked; a partial limit
runs before the shuffle, so no task gathers a lang.

Defined results: null text is empty and null lang is `und`; A-Z alone are lower-cased; rows that repeat count each time;
texts of any length are read whole; a lang with no candidate has no row; an empty table gives no row; doc_id and all
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm import bitmap
from leafmill.session import checkpoint_dir, few, small_arrow_batches

SHARD = 1_000_000  # words
WORD, GAP, END = 0, 1, 2
#: What each byte is, and A-Z in lower case, as tables for bytes.translate.
KIND = bytes(END if c in b".,;:!?\n\v\f\r" else GAP if c in b" \t" else WORD for c in range(256))
LOWER = bytes(range(256)).lower()
NEXT = np.uint64(0x9E3779B97F4A7C15)
HASH, PROBES = 40, (0, 14)  # bits of a phrase's hash, and where the bitmaps take theirs
MASK = np.uint64((1 << HASH) - 1)
VALUES = bitmap.mixed(np.arange(1, 257, dtype=np.uint64) * NEXT)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True."""
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate(([0], edges))
    if len(inside) and inside[-1]:
        edges = np.concatenate((edges, [len(inside)]))
    return edges[::2], edges[1::2]


def dictionary(data: np.ndarray, inside: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Of the runs of bytes, each one's index among the distinct ones, and those as strings."""
    offsets = np.concatenate(([0], np.cumsum(ends - begins))).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]
    coded = pa.Array.from_buffers(pa.large_string(), len(begins), buffers).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def text_hashes(texts: pa.Array) -> np.ndarray:
    """A hash of each text, from its bytes."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    sizes = np.diff(offsets)
    if not len(sizes):
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(int(sizes.max()), NEXT))))
    values = VALUES[data] * powers[np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)]
    return bitmap.mixed(np.add.reduceat(values, offsets[:-1] - offsets[0]) + sizes.astype(np.uint64))


class Words:
    """The words of some texts: `ids` (0 at boundaries), the text of each id, and what bitmaps know it by."""

    def __init__(self, texts: list[str | None], langs: list[str]):
        raw = [(t or "").encode() for t in texts]
        joined = b"\n".join(raw)
        data = np.frombuffer(joined.translate(LOWER), dtype=np.uint8)
        kind = np.frombuffer(joined.translate(KIND), dtype=np.uint8)
        inside = kind == WORD
        begins, ends = spans(inside)
        indices, self.texts = dictionary(data, inside, begins, ends)
        self.langs = sorted(set(langs))
        number = {x: k for k, x in enumerate(self.langs)}
        starts = np.cumsum([0, *(len(x) + 1 for x in raw)])
        held = np.diff(np.searchsorted(begins, starts))  # words of each text
        lang = np.repeat(np.array([number[x] for x in langs], dtype=np.int64), held)
        passed = np.searchsorted(np.flatnonzero(kind == END), begins)
        broken = np.concatenate(([0], (np.diff(passed) > 0).astype(np.int64))) if len(begins) else passed
        pairs = lang * len(self.texts) + indices
        seen = np.zeros(len(self.langs) * len(self.texts), dtype=bool)
        seen[pairs] = True
        self.used = np.flatnonzero(seen)  # of each id, from 1: its lang's number and its text's
        self.ids = np.zeros(len(begins) + int(broken.sum()), dtype=np.int64)
        self.ids[np.arange(len(begins)) + np.cumsum(broken)] = np.cumsum(seen)[pairs]
        n = max(1, len(self.texts))
        of_lang = text_hashes(pa.array([x + "\n" for x in self.langs], pa.large_string()))
        hashed = bitmap.mixed(text_hashes(self.texts)[self.used % n] + of_lang[self.used // n] * NEXT)
        self.hashes = np.concatenate((np.zeros(1, dtype=np.uint64), hashed & MASK))  # by id

    def phrases(self, at: np.ndarray, size: int, ids: np.ndarray) -> pa.Array:
        """lang, a newline and the phrase of so many words that begins at each place. Neither words nor phrases hold a newline."""
        used = self.used if len(self.used) else np.zeros(1, dtype=np.int64)
        found, n = [used[ids[at + j] - 1] for j in range(size)], max(1, len(self.texts))
        lang = pa.array([x + "\n" for x in self.langs], pa.large_string()).take(pa.array(found[0] // n))
        cut, joint = [self.texts.take(pa.array(x % n)) for x in found], lambda c: pa.scalar(c, pa.large_string())
        phrase = cut[0] if size == 1 else pc.binary_join_element_wise(*cut, joint(" "))
        return pc.binary_join_element_wise(lang, phrase, joint("")).cast(pa.string())


def suffix_order(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places `at` in the order of their suffixes' first `depth` words or more; zeros stand behind ids' last place."""
    rank, k = ids, 1
    if depth == 1:
        return at[np.argsort(ids[at])]
    while True:
        last = 2 * k >= depth  # then only the places asked for are sorted; until then all have ranks
        some = at if last else np.nonzero(ids > 0)[0]
        pairs = rank[some] * (int(rank.max(initial=0)) + 1) + rank[np.minimum(some + k, len(ids) - 1)]
        order = np.argsort(pairs)
        if last:
            return at[order]
        ranks = np.cumsum(np.concatenate(([1], np.diff(pairs[order]) != 0)))[: len(some)]
        rank, k = np.zeros(len(ids), dtype=np.int64), 2 * k
        rank[some[order]] = ranks


def intervals(ids: np.ndarray, suffixes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(m, first place, count) of the LCP intervals at each depth m of sizes, whose phrases hold no boundary."""
    shared, whole = np.ones(max(0, len(suffixes) - 1), dtype=bool), np.ones(len(suffixes), dtype=bool)
    for m in range(1, max(sizes) + 1):
        word = ids[suffixes + m - 1]
        whole &= word > 0
        shared &= word[1:] == word[:-1]  # of neighbours, if their common prefix has m words
        if m in sizes and len(suffixes):
            begin = np.nonzero(np.concatenate(([True], ~shared)))[0]
            count = np.diff(np.concatenate((begin, [len(suffixes)])))
            yield m, suffixes[begin[whole[begin]]], count[whole[begin]]


def shards(words: Words, size: int, maps: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(ids with zeros behind, places that begin suffixes, hashes by length) of each shard; what bitmaps rule out is 0.

    A place begins a suffix only if its phrases of all lengths below `size` may occur often enough; hashes hold one array
    for each length up to size.
    """
    ids = words.ids
    if 1 in maps:
        ok = bitmap.holds(maps[1], words.hashes, PROBES)
        ok[0] = False
        ids = np.where(ok[ids], ids, 0)
    for begin in range(0, len(ids), SHARD):
        own = np.concatenate((ids[begin : begin + SHARD + size - 1], np.zeros(size, dtype=np.int64)))
        n = min(SHARD, len(ids) - begin)
        hashes = [words.hashes[own]]
        for m in range(2, size + 1):
            tail = np.concatenate((hashes[0][m - 1 :], np.zeros(m - 1, dtype=np.uint64)))
            hashes.append(bitmap.mixed(hashes[-1] * NEXT + tail) & MASK)
        yield own, np.nonzero(own[:n])[0], hashes


def counted_hashes(docs: DataFrame, size: int, maps: dict[int, np.ndarray], min_count: int) -> DataFrame:
    """`h` of the phrases of `size` words that occur min_count times at least, by hashes."""
    sent = docs.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = Words(b.column("text").to_pylist(), b.column("lang").to_pylist())
            for ids, at, hashes in shards(words, size, sent.value):
                if size > 1:
                    at = at[possible(ids, at, hashes, size, sent.value)]
                for _, first, n in intervals(ids, suffix_order(ids, at, size), [size]):
                    h = hashes[size - 1][first].view(np.int64)
                    order = np.argsort(h)  # neighbours that are alike take less room in the shuffle
                    yield pa.RecordBatch.from_arrays([pa.array(h[order]), pa.array(n[order])], names=["h", "n"])

    counts = docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count).select("h")


def possible(ids: np.ndarray, at: np.ndarray, hashes: list[np.ndarray], size: int, maps: dict[int, np.ndarray]) -> np.ndarray:
    """For each place, if both parts of size - 1 words of the phrase there may occur often enough."""
    ok = np.ones(len(at), dtype=bool)
    for j in range(size):
        ok &= ids[at + j] > 0
    if size > 2:
        for j in (0, 1):
            ok[ok] = bitmap.holds(maps[size - 1], hashes[size - 2][at[ok] + j], PROBES)
    return ok


def fewer_tasks(rows: DataFrame) -> DataFrame:
    """rows in half as many partitions, but not fewer than cores: what two tasks would both send is summed by one."""
    parts = rows.rdd.getNumPartitions()
    most = max(rows.sparkSession.sparkContext.defaultParallelism, (parts + 1) // 2)
    return rows.coalesce(most) if most < parts else rows


def phrase_counts(docs: DataFrame, max_words: int = 3, min_count: int = 10) -> DataFrame:
    """lang, size, phrase and n: phrases of 1 to max_words words with n >= min_count, and size 0 with all words of the lang."""
    spark = docs.sparkSession
    small_arrow_batches(spark, "4m")
    narrow = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    narrow = fewer_tasks(narrow)
    maps: dict[int, np.ndarray] = {}
    for m in range(1, max_words + 1):
        maps[m] = bitmap.of(counted_hashes(narrow, m, maps, min_count), PROBES)
    sent = spark.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = Words(b.column("text").to_pylist(), b.column("lang").to_pylist())
            lang_of = words.used[words.ids[words.ids > 0] - 1] // max(1, len(words.texts))
            of_lang = np.bincount(lang_of, minlength=len(words.langs))
            yield pa.RecordBatch.from_arrays([pa.array([x + "\n" for x in words.langs], pa.string()), pa.array(of_lang)], names=["key", "n"])
            for ids, at, hashes in shards(words, max_words, sent.value):
                for m, first, n in intervals(ids, suffix_order(ids, at, max_words), list(range(1, max_words + 1))):
                    ok = possible(ids, first, hashes, m, sent.value)
                    if m > 1:
                        ok[ok] = bitmap.holds(sent.value[m], hashes[m - 1][first[ok]], PROBES)
                    keys = words.phrases(first[ok], m, ids)
                    order = pc.sort_indices(keys)
                    yield pa.RecordBatch.from_arrays([keys.take(order), pa.array(n[ok]).take(order)], names=["key", "n"])

    summed = narrow.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    phrase = F.substring_index("key", "\n", -1)
    size = F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1)
    lang = F.substring("key", F.lit(1), F.length("key") - F.length(phrase) - 1)
    found = summed.select(lang.alias("lang"), size.alias("size"), phrase.alias("phrase"), "n")
    return found.where((F.col("n") >= min_count) | (F.col("size") == 0))


SCORE = """cast((1000000BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0)))
  div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)"""


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, score of the candidates among counts, by each one's lowest-scoring cut."""
    words = F.split("phrase", " ")
    held = counts.where("size >= 2").select("lang", "size", F.col("n").alias("a"), words.alias("w"))
    cut = held.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    parts = cut.select(
        "lang", "size", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size")), " ").alias("right"),
    )
    part = lambda name, n: counts.where("size >= 1").select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = parts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    whole = F.concat_ws(" ", "left", "right").alias("phrase")
    lowest = F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r")).alias("cut")
    one = [F.first(c).alias(c) for c in ("size", "a")]  # grouped as `longest` is, so that both meet where they are
    return both.groupBy("lang", whole).agg(*one, lowest).select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def longest(counts: DataFrame, max_words: int) -> DataFrame:
    """(lang, phrase, longer): of phrases inside longer candidates, the most that one of these occurs."""
    words = F.split("phrase", " ")

    def parts(m: int) -> Column:
        starts = F.sequence(F.lit(1), F.col("size") - m + 1)
        some = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(m)), " "))
        return F.when(F.col("size") > m, some).otherwise(F.array().cast("array<string>"))

    inner = [parts(m) for m in range(2, max_words)]
    each = F.concat(*inner) if inner else F.array().cast("array<string>")
    longer = counts.where("size >= 3").select("lang", F.col("n").alias("longer"), F.explode(each).alias("phrase"))
    return longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, top: int = 2000, percent: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's best phrases. docs has text and lang."""
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases have two words or more and occur once or more")
    checkpoint_dir(docs.sparkSession)
    counts = phrase_counts(docs, max_words, min_count).checkpoint()
    totals = counts.where("size = 0").select("lang", F.col("n").alias("n"))
    met = scored(counts).join(longest(counts, max_words), ["lang", "phrase"], "left")
    kept = met.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)).drop("longer")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    found = ranked.join(few(totals), "lang")
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), cut AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM piece
), gram AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM cut
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM cut
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM cut
), f AS (SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS a FROM gram GROUP BY lang, size, phrase
), total AS (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang
), candidate AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND a >= 10
), part AS (
  SELECT lang, phrase, size, a, 1 AS k, w[1] AS p, array_to_string(w[2:], ' ') AS q FROM candidate
  UNION ALL SELECT lang, phrase, size, a, 2, w[1] || ' ' || w[2], w[3] FROM candidate WHERE size = 3
), scored AS (
  SELECT t.lang, t.phrase, t.size, t.a, t.k, x.a AS l, y.a AS r, (1000000::HUGEINT * t.a * t.a) // (x.a * y.a) AS score
  FROM part t JOIN f x ON x.lang = t.lang AND x.phrase = t.p JOIN f y ON y.lang = t.lang AND y.phrase = t.q
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, w[1] || ' ' || w[2] AS phrase, a AS longer FROM candidate WHERE size = 3
  UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidate WHERE size = 3
), most AS (SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY lang, phrase
), kept AS (
  SELECT s.* FROM lowest s LEFT JOIN most m ON m.lang = s.lang AND m.phrase = s.phrase WHERE m.longer IS NULL OR 100 * m.longer < 50 * s.a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
