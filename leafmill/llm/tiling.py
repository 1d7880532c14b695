"""Benchmark decontamination by greedy string tiling.

Texts are cut into lower-cased words. Runs of `least` words (an item's whole length, if shorter) that a document shares
with an item are seeds; they are joined on their hash. Where the item's words under seeds could reach the threshold, the
document's seeded runs and the item are tiled: again and again the longest match of unmarked words is marked in both; of
equal ones the first in the item, then in the document. Matches do not overlap, so reordered passages still add up. An
item is found in a document if its tiles cover `coverage` of the item's words.

The longest match's length is found by bisection: running Karp-Rabin hashes of a length, from prefix sums in linear time,
tell if any unmarked run of it is in both. All matches of that length are marked in one pass, so a tiling takes
(item + document) * log(item) steps for each distinct length of its tiles, repeated words or not.

An item table of at most `block_bytes` of text is sent to all tasks, which decide their documents where they read them:
nothing is shuffled, and a passage in a third of all documents makes no hot group. A larger one is joined by seeds: a
bitmap of FILTER_BITS bits, whatever the table's size, leaves of the documents' runs nearly only seeds, these meet the
items' seeds in a shuffle (salted, as a seed may be in a third of all documents), and pairs of a document and an item that
could reach the threshold are tiled, one at a time. Both ways give the same rows.

Defined results: null or empty texts have no words and match nothing; items without words are never found; equal items
with several ids are each found, and so are repeated items for each row; repeated documents are each reported; ids may
have any type; other columns pass through `decontaminate`, under any names, and are ignored by `matches`. Texts of any
length are read whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leafmill.session import checkpoint_dir, few, map_rows, quoted, small_arrow_batches

WORD = re.compile(r"\w+")
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
FILTER_BITS = 1 << 27
SALTS = 16
TILES = "coverage double, n_tiles int, longest int, tiles array<struct<item:int,doc:int,size:int>>"
FIELDS = [pa.field("coverage", pa.float64()), pa.field("n_tiles", pa.int32()), pa.field("longest", pa.int32()), pa.field("tiles", pa.list_(pa.struct([("item", pa.int32()), ("doc", pa.int32()), ("size", pa.int32())])))]


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Running:
    """Karp-Rabin hashes, modulo 2**64, of the runs of some ids: of any size in linear time."""

    def __init__(self, ids: np.ndarray):
        v = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        v = (v ^ v >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(v * powers(BASE, len(v)))))
        self.back = powers(INVERSE, len(v))

    def of(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return (self.sums[size:] - self.sums[:n]) * self.back[:n] if n else np.zeros(0, dtype=np.uint64)


def running(ids: np.ndarray, size: int) -> np.ndarray:
    return Running(ids).of(size)


def free_runs(marked: np.ndarray, size: int) -> np.ndarray:
    """Where a run of `size` has no marked word."""
    before = np.concatenate(([0], np.cumsum(marked)))
    return np.nonzero(before[size:] == before[:-size])[0] if len(marked) >= size else np.zeros(0, dtype=np.int64)


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Non-overlapping matches (item position, document position, length), the longest marked first.

    Words equal if their ids are equal and positive.
    """
    marked = [np.zeros(len(item), dtype=bool), doc <= 0]
    hashed = [Running(item), Running(doc)]
    tiles: list[tuple[int, int, int]] = []

    def free(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for m, h in zip(marked, hashed, strict=True):
            at = free_runs(m, size)
            out.append((at, h.of(size)[at]))
        return out

    def meets(size: int) -> bool:
        (_, a), (_, b) = free(size)
        return bool(len(a) and len(b)) and bool(np.isin(a, b).any())

    top = min(len(item), len(doc))
    while True:
        low, high = least - 1, top  # some match of length low (if not least - 1), none over high
        while low < high:
            size = (low + high + 1) // 2
            low, high = (size, high) if meets(size) else (low, size - 1)
        if low < least:
            return tiles
        (i_at, own), (d_at, theirs) = free(low)
        shared = np.isin(own, theirs)
        i_at, own = i_at[shared], own[shared]
        places: dict[int, list[int]] = defaultdict(list)
        for h, d in zip(theirs.tolist(), d_at.tolist(), strict=True):
            places[h].append(d)
        nexts: dict[int, int] = defaultdict(int)
        end = -1
        for i, h in zip(i_at.tolist(), own.tolist(), strict=True):
            if i < end:
                continue
            here, k = places[h], nexts[h]
            while k < len(here) and (marked[1][here[k]] or marked[1][here[k] + low - 1]):
                k += 1  # runs of one length overlap only at an end
            if k < len(here) and np.array_equal(item[i : i + low], doc[here[k] : here[k] + low]):
                marked[0][i : i + low] = marked[1][here[k] : here[k] + low] = True
                tiles.append((i, here[k], low))
                end = i + low
            nexts[h] = k
        top = low - 1


class Items:
    """Some items, ready to be looked for."""

    def __init__(self, rows: list[tuple[object, str | None]], least: int, coverage: float):
        self.least, self.coverage = least, coverage
        self.ids: list[object] = []
        self.texts: list[np.ndarray] = []
        self.seeds_of: list[np.ndarray] = []
        self.vocabulary: dict[str, int] = {}
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in rows:
            cut = words(text)
            if not cut:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in cut], dtype=np.int32)
            size = min(least, len(ids))
            own = running(ids, size)
            seeds[size] += [(h, len(self.ids)) for h in np.unique(own).tolist()]
            self.ids.append(item_id)
            self.texts.append(ids)
            self.seeds_of.append(own)
        self.seeds = {}
        for size, found in seeds.items():
            found.sort()
            self.seeds[size] = (np.array([h for h, _ in found], dtype=np.uint64), np.array([i for _, i in found], dtype=np.int64))

    def numbered(self, text: str | None) -> np.ndarray:
        cut = words(text)
        return np.fromiter(map(self.vocabulary.get, cut, repeat(0)), dtype=np.int32, count=len(cut))

    def find(self, text: str | None) -> list[dict]:
        """The items found in a text."""
        doc, out = self.numbered(text), []
        for size, (hashes, items) in self.seeds.items():
            at = free_runs(doc <= 0, size)
            if not len(at):
                continue
            own = running(doc, size)[at]
            hit = hashes[np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)] == own
            at, own = at[hit], own[hit]
            if not len(at):
                continue
            met = np.unique(own)
            low, high = np.searchsorted(hashes, met, "left"), np.searchsorted(hashes, met, "right")
            for k in np.unique(np.concatenate([items[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)])).tolist():
                if (m := self.tiled(k, size, doc, at, own)) is not None:
                    out.append((k, m))
        return [m for _, m in sorted(out, key=lambda x: x[0])]

    def tiled(self, k: int, size: int, doc: np.ndarray, at: np.ndarray, own: np.ndarray) -> dict | None:
        """Item k in a document whose runs at `at` have the hashes `own`, if it is found."""
        item, seeds = self.texts[k], self.seeds_of[k]
        step = np.zeros(len(item) + 1, dtype=np.int64)
        hit = np.nonzero(np.isin(seeds, own))[0]
        np.add.at(step, hit, 1)
        np.add.at(step, hit + size, -1)
        if (np.cumsum(step)[:-1] > 0).sum() < self.coverage * len(item):
            return None  # tiles lie under seeds
        starts = at[np.isin(own, seeds)]
        step = np.zeros(len(doc) + 1, dtype=np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + size, -1)
        under = np.nonzero(np.cumsum(step)[:-1] > 0)[0]
        place = np.arange(len(under)) + np.concatenate(([0], np.cumsum(np.diff(under) > 1)))  # a zero where words are left out
        packed, back = np.zeros(place[-1] + 1, dtype=np.int32), np.zeros(place[-1] + 1, dtype=np.int64)
        packed[place], back[place] = doc[under], under
        tiles = tile(item, packed, size)
        share = sum(n for _, _, n in tiles) / len(item)
        if share < self.coverage:
            return None
        return {"item_id": self.ids[k], "coverage": share, "n_tiles": len(tiles), "longest": max(n for _, _, n in tiles), "tiles": [{"item": i, "doc": int(back[d]), "size": n} for i, d, n in sorted(tiles)]}


def text_bytes(benchmark: DataFrame) -> int:
    return benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def matches(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.8, block_bytes: int = 4_000_000) -> DataFrame:
    """A row for each item found in a document: doc_id, item_id, coverage and the tiles, in words of both."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    narrow = docs.select("doc_id", "text")
    if text_bytes(benchmark) > block_bytes:
        return by_seeds(narrow, benchmark, least, coverage).select("doc_id", "item_id", *[f.name for f in FIELDS])
    rows = [(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").collect()]  # at most block_bytes
    sent = spark.sparkContext.broadcast((rows, least, coverage))
    id_type = to_arrow_type(benchmark.schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*sent.value)
        for b in batches:
            found = [(k, m) for k, t in enumerate(b.column("text").to_pylist()) for m in items.find(t)]
            if found:
                ids = [b.column("doc_id").take(pa.array([k for k, _ in found])), pa.array([m["item_id"] for _, m in found], id_type)]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array([m[f.name] for _, m in found], f.type) for f in FIELDS)], names=["doc_id", "item_id", *(f.name for f in FIELDS)])

    kinds = [f"{c} {t.schema[c].dataType.simpleString()}" for c, t in (("doc_id", docs), ("item_id", benchmark))]
    return narrow.mapInArrow(run, ", ".join([*kinds, TILES]))


def seeds_in(text: str | None, sizes: list[int] | None, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Distinct seeds of a text, how often it has each, and its words: seeds of its own size (sizes: None), or of some sizes."""
    cut = words(text)
    if cut:
        hashed = Running(np.fromiter(map(xxhash.xxh64_intdigest, cut), dtype=np.uint64, count=len(cut)))
        for n in [min(least, len(cut))] if sizes is None else sizes:
            yield *np.unique(hashed.of(n) + np.uint64(n), return_counts=True), len(cut)


def by_seeds(docs: DataFrame, benchmark: DataFrame, least: int, coverage: float) -> DataFrame:
    """`matches` of docs (doc_id, text) by a join on seeds, with the hash of the text as __hash."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    texts = benchmark.where("text is not null").select(F.xxhash64("text").alias("ik"), F.col("text").alias("item")).dropDuplicates(["ik"])

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ik, t in zip(b.column("ik").to_pylist(), b.column("item").to_pylist(), strict=True):
                for found, times, n in seeds_in(t, None, least):
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), ik)), pa.array(times), pa.array(np.full(len(found), n, dtype=np.int32))], names=["seed", "ik", "times", "n"])

    item_seeds = texts.mapInArrow(of_items, "seed long, ik long, times long, n int").checkpoint()
    sizes = [r[0] for r in item_seeds.select(F.least("n", F.lit(least))).distinct().collect()]  # at most `least`
    bit = F.pmod("seed", F.lit(FILTER_BITS))
    packed = item_seeds.select(F.floor(bit / 64).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(pmod(seed, {FILTER_BITS}) % 64 as int))").alias("b")).groupBy("at").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bits[packed.column("at").to_numpy()] = packed.column("b").to_numpy()
    sent = spark.sparkContext.broadcast((bits.view(np.uint64), sizes))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, own_sizes = sent.value
        for b in batches:
            for k, t in enumerate(b.column("text").to_pylist()):
                for found, _, _ in seeds_in(t, own_sizes, least):
                    at = (found.view(np.int64) % FILTER_BITS).astype(np.uint64)
                    found = found[(bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
                    if len(found):
                        again = pa.array([k] * len(found))
                        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(again), b.column("__hash").take(again), pa.array(found.view(np.int64))], names=["doc_id", "__hash", "seed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("__hash"), "text")
    seen = keyed.mapInArrow(of_docs, f"doc_id {kind}, __hash long, seed long").withColumn("salt", F.pmod(F.xxhash64("doc_id", "__hash"), F.lit(SALTS)))
    dealt = item_seeds.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = seen.join(dealt, ["seed", "salt"]).groupBy("doc_id", "__hash", "ik").agg(F.sum("times").alias("places"), F.first("n").alias("n"))
    pairs = met.where(F.col("places") * F.least("n", F.lit(least)) >= coverage * F.col("n")).select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__h"), "ik").checkpoint()
    both = keyed.join(pairs, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h"))).join(texts, "ik").select("doc_id", "__hash", "ik", "item", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, m) for k, (i, t) in enumerate(zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True)) for m in Items([(0, i)], least, coverage).find(t)]
            if found:
                at = pa.array([k for k, _ in found])
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("doc_id", "__hash", "ik")), *(pa.array([m[f.name] for _, m in found], f.type) for f in FIELDS)], names=["doc_id", "__hash", "ik", *(f.name for f in FIELDS)])

    tiled = both.mapInArrow(run, f"doc_id {kind}, __hash long, ik long, {TILES}")
    ids = benchmark.select("item_id", F.xxhash64("text").alias("ik"))
    return tiled.join(ids, "ik")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.8, block_bytes: int = 4_000_000) -> DataFrame:
    """The rows of docs, with all columns, in which no item is found."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    if text_bytes(benchmark) > block_bytes:
        boxed = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
        gone = by_seeds(docs.select("doc_id", "text"), benchmark, least, coverage).select("doc_id", "__hash").distinct().checkpoint()
        kept = boxed.join(few(gone), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("__hash")), "left_anti")
        return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    rows = [(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").collect()]
    sent = spark.sparkContext.broadcast((rows, least, coverage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*sent.value)
        for b in batches:
            yield b.filter(pa.array([not items.find(t) for t in b.column("text").to_pylist()], pa.bool_()))

    return map_rows(docs, run, "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
