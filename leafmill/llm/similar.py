"""Near-duplicates by SimHash and the generalised pigeonhole, and exactly by the shingle sets' own bits beyond the radius.

First the method of `simhash` runs on fingerprints of the texts' shingle sets: correlated bits are grouped, thresholds of
least estimated work are allocated by dynamic programming, fingerprints are probed, and those within `simhash`'s radius are
verified on their sets. Sets of one fingerprint are verified against the least of them. What this links is one class.

A SimHash of 64 bits shows a Jaccard similarity of 0.8 as about ten differing bits, with a deviation of three. A radius
that misses few such pairs (15) leaves the pigeonhole no selective partition, and its links would be right by chance only.
So an exact search follows for the pairs that the first step left in different classes. It takes the widest fingerprint
there is, the set of all 64-bit shingle hashes with one bit for each: partitions, unequal thresholds, probe, verify.

A set of n bits may miss n - ceil(similarity * n) of them in a similar set; so of any one bit more, one is shared. Every
bit is a partition, with threshold 0 (probed) or -1 (not probed). The estimated candidates of a bit follow from counts of
all shingles of all documents in COUNTERS counters. With one bit a partition the cheapest allocation is to probe the bits
of least estimate, by one order for all sets: (estimate's size class, hash). Then the first bit that two similar sets share
is probed by both, none is lost, and a passage that many documents share is probed by those alone that hardly have
anything else.

Sets that meet at a bit are candidates if what follows their first shared bit can still reach the similarity (positions
and sizes tell), and if the parities of their hashes in some counters differ in no more places than similar sets can
differ in bits (each bit that one set alone has changes one parity). Candidates are verified on their texts' sets. At a bit where over `LIMIT` sets meet, all first meet the
PIVOTS of least number; verified links make classes, and then only members of different classes are compared, block by
block. So large groups of near copies give no squares; groups whose pairs all lie just around the similarity do.

Defined results: two texts are linked if the Jaccard similarity of their sets of distinct shingles is at least
`similarity`, which is 0.5 to 1 (classes may join less similar texts by chains); a text of fewer words than a shingle is one shingle; texts
without words (null, empty) are one class. Words are runs without ASCII white space, A-Z in lower case. Rows that repeat
are of one class. Columns may have any names; doc_id may have any type that can be ordered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import simhash
from leafmill.llm.simhash import SEED, keep_first, stars
from leafmill.session import checkpoint_dir, few, shuffles_cleared, small_arrow_batches

COUNTERS = 1 << 18
LIMIT = 16
PIVOTS = 4
BLOCK = 8_192
PIECE = 1 << 20  # bytes


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


#: A random value for each byte, that of the small letter for A-Z; and which bytes are white space.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BYTES[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]
SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end in data, and the number of words before each offset."""
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    starts = np.nonzero(begins)[0]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    at = np.nonzero(inside)[0]
    first = np.nonzero(begins[at])[0]
    sizes = np.diff(np.concatenate((first, [len(at)])))
    powers = np.full(sizes.max(), BASE)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.add.reduceat(BYTES[data[at]] * powers[np.arange(len(at)) - np.repeat(first, sizes)], first)
    return mixed(sums + sizes.astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of some texts, end to end and repeats included, and where each text's begin and end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    parts, counts, k = [], [], 0
    while k < len(texts):  # texts of together about PIECE bytes at a time, a longer one alone
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + PIECE, "right")) - 1)
        words, held = word_hashes(data[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k])
        h, n = shingled(words, held, width)
        parts.append(h)
        counts.append(n)
        k = end
    return np.concatenate(parts or [np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum(np.concatenate(counts or [np.zeros(0, np.int64)]))))


def shingled(words: np.ndarray, held: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts given by their words' hashes, and each text's number of them."""
    sizes = np.diff(held)
    out = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for k in range(width):
        out = out * BASE + words[k : k + len(out)]
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    after = np.concatenate(([0], np.cumsum(counts)))
    hashes, long = np.zeros(after[-1], dtype=np.uint64), sizes >= width
    at = np.repeat(held[:-1] - after[:-1], counts) + np.arange(after[-1])
    whole = np.repeat(long, counts)
    hashes[whole] = out[at[whole]]
    for k in np.nonzero((sizes > 0) & ~long)[0].tolist():
        h = int(sizes[k])
        for w in words[held[k] : held[k + 1]].tolist():
            h = (h * int(BASE) + w) & 0xFFFFFFFFFFFFFFFF
        hashes[after[k]] = h
    return mixed(hashes), counts


def counters(docs: DataFrame, width: int) -> np.ndarray:
    """How many shingles of all documents fall into each counter. A task sends at most COUNTERS sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for b in batches:
            hashes, _ = shingle_hashes(b.column("text"), width)
            total += np.bincount((hashes >> np.uint64(46)).astype(np.int64), minlength=COUNTERS)
        at = np.nonzero(total)[0]
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["at", "n"])

    summed = docs.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[summed.column("at").to_numpy()] = summed.column("n").to_numpy()
    return out


def probed(hashes: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The bits of a set (sorted hashes) that are probed, in the common order."""
    n = len(hashes)
    if not n:
        return hashes
    ranks = rank[(hashes >> np.uint64(46)).astype(np.int64)]
    return hashes[np.argsort(ranks, kind="stable")[: n - math.ceil(similarity * n - 1e-9) + 1]]


def parities(hashes: np.ndarray) -> np.ndarray:
    """Of the bits of a set in each of some counters, a power of two and at least two for each bit, packed in longs."""
    n = 1 << max(8, (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes >> np.uint64(8)).astype(np.int64) & (n - 1), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def listed(parts: list[np.ndarray]) -> pa.Array:
    """Arrays of longs as one Arrow list array."""
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), pa.int64()))


def gated(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of different labels whose sets (node, size, odd, label) do not differ in more parities than similar ones can.

    Sizes of a pair are within the similarity of each other, so one has at most twice the other's counters; halves fold.
    """
    side = lambda node, odd, size, label: sets.select(F.col("node").alias(node), F.col("odd").alias(odd), F.col("size").alias(size), F.col("label").alias(label))
    half = lambda c: (F.size(c) / 2).cast("int")
    folded = lambda c, other: F.when(F.size(c) > F.size(other), F.zip_with(F.slice(c, F.lit(1), half(c)), F.slice(c, half(c) + 1, half(c)), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))
    apart = F.aggregate(F.zip_with(folded("a", "b"), folded("b", "a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    met = pairs.join(side("u", "a", "p", "x"), "u").join(side("v", "b", "q", "y"), "v").where("x <> y")
    return met.where(apart <= (1 - similarity) / (1 + similarity) * (F.col("p") + F.col("q")) + 1e-6).select("u", "v")


def can_reach(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """If sets of these (size, position) can be similar, should the bit at the positions be the first they share."""
    left = np.minimum(a[0] - a[1], b[0] - b[1])
    return left >= similarity / (1 + similarity) * (a[0] + b[0]) - 1e-6


def meetings(keyed: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of candidates that meet at a bit of few sets or at a pivot; for bits of many sets each member's key, u, size, at.

    keyed: key, node, size, at. Rows are sorted by key and node and streamed; a bit of many sets needs no more memory than
    an Arrow batch, as only pivots are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "node", "size", "at")
        rest = {c: np.zeros(0, dtype=np.int64) for c in names}
        open_key, pivots = None, None  # a long run that began in an earlier batch

        def out(u: np.ndarray, v: np.ndarray | None, t: dict | None = None, at: np.ndarray | None = None) -> pa.RecordBatch:
            none = pa.nulls(len(u), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(u), none if v is None else pa.array(v), *(none if t is None else pa.array(t[c][at]) for c in ("key", "size", "at"))], names=["u", "v", "key", "size", "at"])

        def with_pivots(t: dict, at: np.ndarray, p: dict) -> Iterator[pa.RecordBatch]:
            for k in range(len(p["node"])):
                ok = at[can_reach((t["size"][at], t["at"][at]), (p["size"][k], p["at"][k]), similarity) & (t["node"][at] != p["node"][k])]
                if len(ok):
                    yield out(np.minimum(t["node"][ok], p["node"][k]), np.maximum(t["node"][ok], p["node"][k]))
            if len(at):
                yield out(t["node"][at], None, t, at)

        def settled(t: dict) -> Iterator[pa.RecordBatch]:
            """All of whole runs."""
            key = t["key"]
            if not len(key):
                return
            begins = np.concatenate(([0], np.nonzero(key[1:] != key[:-1])[0] + 1))
            sizes = np.diff(np.concatenate((begins, [len(key)])))
            small = np.repeat(sizes <= LIMIT, sizes)
            i = np.nonzero(small)[0]
            for d in range(1, LIMIT):
                i = i[i + d < len(key)]
                i = i[key[i] == key[i + d]]
                if not len(i):
                    break
                ok = i[can_reach((t["size"][i], t["at"][i]), (t["size"][i + d], t["at"][i + d]), similarity)]
                if len(ok):
                    yield out(t["node"][ok], t["node"][ok + d])
            for k in np.nonzero(sizes > LIMIT)[0].tolist():
                at = np.arange(begins[k], begins[k] + sizes[k])
                yield from with_pivots(t, at, {c: t[c][at[:PIVOTS]] for c in names})

        for b in batches:
            t = {c: np.concatenate((rest[c], b.column(c).to_numpy(zero_copy_only=False).astype(np.int64))) for c in names}
            if not len(t["key"]):
                continue
            if open_key is not None:
                n = int(np.searchsorted(t["key"] != open_key, True)) if t["key"][-1] != open_key else len(t["key"])
                yield from with_pivots(t, np.arange(n), pivots)
                t = {c: t[c][n:] for c in names}
                if not len(t["key"]):
                    rest = t
                    continue
                open_key = None
            last = int(np.nonzero(t["key"] != t["key"][-1])[0][-1]) + 1 if t["key"][0] != t["key"][-1] else 0
            yield from settled({c: t[c][:last] for c in names})
            rest = {c: t[c][last:] for c in names}
            if len(rest["key"]) > LIMIT:
                open_key, pivots = rest["key"][0], {c: rest[c][:PIVOTS].copy() for c in names}
                yield from with_pivots(rest, np.arange(len(rest["key"])), pivots)
                rest = {c: rest[c][:0] for c in names}
        yield from settled(rest)

    dealt = keyed.repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "u long, v long, key long, size long, at long")


def across(members: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of members of different classes that meet at one bit. members: key, node, size, at, label, n (at the key)."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "size", "at", "label")

    def run(t: pa.Table) -> pa.Table:
        c = {n: t.column(n).to_numpy() for n in ("own", "node", "size", "at", "label")}
        two, us, vs = len(np.unique(c["own"])) > 1, [], []
        if t.column("low")[0].as_py() == t.column("high")[0].as_py() or two:
            for i in range(len(c["node"]) - 1):
                rest = slice(i + 1, None)
                ok = can_reach((c["size"][rest], c["at"][rest]), (c["size"][i], c["at"][i]), similarity) & (c["label"][rest] != c["label"][i])
                if two:
                    ok &= c["own"][rest] != c["own"][i]
                found = c["node"][rest][ok]
                us.append(np.minimum(found, c["node"][i]))
                vs.append(np.maximum(found, c["node"][i]))
        empty = np.zeros(0, dtype=np.int64)
        return pa.table({"u": np.concatenate(us) if us else empty, "v": np.concatenate(vs) if vs else empty})

    return dealt.groupBy("key", "low", "high").applyInArrow(run, "u long, v long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, marks: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (u, v), u < v, whose sets are similar. Only texts of candidates are read, one for each set."""
    pairs = pairs.checkpoint()
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__hash")).alias("one")
    wanted = marks.select("node", "doc_id", "__hash").join(nodes, "node", "left_semi").groupBy("node").agg(one).select("node", F.col("one.doc_id").alias("__id"), F.col("one.__hash").alias("__h")).checkpoint()
    read = docs.select("doc_id", F.xxhash64("text").alias("__hash"), "text").join(few(wanted), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")))
    texts = read.select("node", "text").dropDuplicates(["node"])
    met = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (x, x_at), (y, y_at) = shingle_hashes(b.column("a"), width), shingle_hashes(b.column("b"), width)
            ok = np.zeros(b.num_rows, dtype=bool)
            for k in range(b.num_rows):
                p, q = np.unique(x[x_at[k] : x_at[k + 1]]), np.unique(y[y_at[k] : y_at[k + 1]])
                shared = len(np.intersect1d(p, q, assume_unique=True))
                ok[k] = shared >= similarity * (len(p) + len(q) - shared) - 1e-9
            yield b.select(["u", "v"]).filter(pa.array(ok))

    return met.mapInArrow(run, "u long, v long").checkpoint()


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """(u, v), u < v, of sets (node, fingerprint) whose fingerprints the generalised pigeonhole finds within its radius.

    Each fingerprint stands by its least node; the other nodes of a fingerprint meet that one. So there are no squares.
    """
    prints = sets.groupBy("fingerprint").agg(F.min("node").alias("least"), F.count("*").alias("n")).checkpoint()
    stands = lambda f, node: prints.select(F.col("fingerprint").alias(f), F.col("least").alias(node))
    near = simhash.links(prints.select("fingerprint")).join(stands("u", "x"), "u").join(stands("v", "y"), "v")
    same = sets.select("fingerprint", "node").join(few(prints.where("n > 1").select("fingerprint", "least")), "fingerprint").where("least < node")
    return near.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).union(same.select(F.col("least").alias("u"), F.col("node").alias("v")))


def labelled(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """rows with `label`, the smallest node that their node is linked with in `stars`."""
    roots = few(linked.select(F.col("v").alias("__node"), F.col("u").alias("__root")))
    return rows.join(roots, F.col("node") == F.col("__node"), "left").withColumn("label", F.coalesce("__root", "node")).drop("__node", "__root")


def similar_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, __hash (of the text) and root of each row: rows of one root are near-duplicates. similarity: 0.5 to 1."""
    if not 0.5 <= similarity <= 1:
        raise ValueError("the similarity is 0.5 to 1: below, sets of a pair may have more than twice each other's parities")
    spark = docs.sparkSession
    checkpoint_dir(spark)
    small_arrow_batches(spark)
    rank = np.ceil(np.log2(counters(docs, width) + 1)).astype(np.uint8)
    sent = spark.sparkContext.broadcast(rank)  # COUNTERS bytes
    narrow = docs.select("doc_id", F.xxhash64("text").alias("__hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, at = shingle_hashes(b.column("text"), width)
            sets = [np.unique(hashes[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), dtype=np.uint64, count=len(sets)).view(np.int64)
            keys = [probed(s, sent.value, similarity).view(np.int64) for s in sets]
            odd = listed([parities(s) for s in sets])
            prints = np.fromiter((simhash.majority(s) for s in sets), dtype=np.uint64, count=len(sets)).view(np.int64)
            found = [b.column("doc_id"), b.column("__hash"), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), listed(keys), odd]
            yield pa.RecordBatch.from_arrays(found, names=["doc_id", "__hash", "node", "size", "fingerprint", "keys", "odd"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    marks = narrow.mapInArrow(run, f"doc_id {kind}, __hash long, node long, size long, fingerprint long, keys array<long>, odd array<long>").checkpoint()
    single = marks.select("node", "size", "fingerprint", "odd", F.col("node").alias("label")).dropDuplicates(["node"]).checkpoint()
    links = verified(gated(fingerprint_pairs(single), single, similarity), docs, marks, width, similarity)
    linked = stars(links)
    sets = labelled(single.drop("label"), linked).select("node", "size", "odd", "label").checkpoint()
    keyed = marks.select("node", "size", "keys").dropDuplicates(["node"]).select("node", "size", F.posexplode("keys").alias("at", "key")).select("key", "node", "size", F.col("at").cast("long").alias("at"))
    met = meetings(keyed, similarity).checkpoint()
    linked = stars(linked.union(verified(gated(met.where("v is not null").select("u", "v").distinct(), sets, similarity), docs, marks, width, similarity)))
    many = met.where("v is null").select("key", F.col("u").alias("node"), "size", "at")
    if many.limit(1).count():
        members = labelled(many, linked).checkpoint()
        mixed_keys = members.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key", "n")
        candidates = gated(across(members.join(mixed_keys, "key"), similarity), sets, similarity)
        linked = stars(linked.union(verified(candidates, docs, marks, width, similarity)))
    return labelled(marks, linked).select("doc_id", "__hash", F.col("label").alias("root"))


def keep_one_of_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without those similar to a kept one: of each class the row of smallest doc_id.

    Of rows that repeat a doc_id in one class one stays. Rows without doc_id go where their class has a row with one, else
    the smallest text hash stays. All columns pass, under any names.
    """
    with shuffles_cleared(docs.sparkSession):
        rooted = similar_classes(docs, width, similarity).checkpoint()
    return keep_first(docs, rooted)
