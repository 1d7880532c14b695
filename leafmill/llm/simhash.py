"""SimHash near-duplicates by generalised pigeonhole.

Fingerprints that differ in at most `radius` bits are linked. The 64 bits are grouped so that correlated bits share a
partition; dynamic programming gives every partition its own threshold, so that the estimated work is least while
thresholds still sum to radius - partitions + 1 (then any linked pair agrees within the threshold in some partition).
Each fingerprint is indexed by its exact value in each partition and probes the values within the threshold; pairs that
meet in a bucket are verified.

A bucket of over `bucket_limit` members emits no pairs. Its members are linked exactly and in linear space instead: two
fingerprints are within 2 bits if and only if the balls of radius 1 around them meet, so each member sends its 65 ball
keys and everyone at a key is linked to the smallest member there. That needs radius 2; smaller radii verify the star.

Two bits of 64 are far stricter than a similarity of 0.8; `similar` runs this method first and then finds exactly what lies
beyond the radius. The pipeline's stage uses it.

Defined results: null or empty texts have fingerprint zero and are linked like any other; a text of one or two words is
one shingle; rows with the same doc_id are separate rows with one component; a null doc_id never names a component
unless the whole component has none (then null). Other columns of the input are ignored, so they may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import checkpoint_dir, few, quoted, small_arrow_batches

BITS = 64
SEED = 42
PART = 100_000  # edges of a partition


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
    return majority(np.fromiter((digest(joined[s:e], SEED) for s, e in spans), dtype="<u8", count=n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes, unsigned."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):  # whole texts in pieces of bounded memory
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys of each row and `fingerprint`, a long with the 64 bits."""
    small_arrow_batches(docs.sparkSession)
    narrow = docs.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]), "fingerprint long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t) for t in b.column("__text").to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(found.view(np.int64))], names=[*keys, "fingerprint"])

    return narrow.mapInArrow(run, schema)


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and the 64 x 64 counts of bits that are set together, over all of them.

    Each task sends at most 64 * 65 / 2 sums, whatever it reads.
    """
    rows, cols = np.triu_indices(BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), dtype=np.float64)
        for b in batches:
            v = b.column("fingerprint").to_numpy(zero_copy_only=False).astype("<i8")
            x = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
        n = total[rows, cols].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(cols.astype(np.int32)), pa.array(n)], names=["i", "j", "n"])

    summed = distinct.select("fingerprint").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    together = np.zeros((BITS, BITS))
    for r in summed.collect():  # 2080 rows at any size
        together[r["i"], r["j"]] = together[r["j"], r["i"]] = r["n"]
    return distinct.count(), together


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal width, the most correlated bits together."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        free = sorted(left)
        seed = max(free, key=lambda b: (corr[b, free].sum(), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < width:
            best = max(sorted(left), key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def near_share(p: np.ndarray, at_most: int) -> float:
    """The share of pairs of fingerprints expected to differ in at most so many of these bits (Poisson-binomial)."""
    odds = np.zeros(at_most + 1)
    odds[0] = 1.0
    for q in 2 * p * (1 - p):
        odds[1:] = odds[1:] * (1 - q) + odds[:-1] * q
        odds[0] *= 1 - q
    return float(odds.sum())


def plan(n: int, together: np.ndarray, radius: int = 2, most_parts: int = 6) -> tuple[list[list[int]], list[int]]:
    """Bit groups and their thresholds (-1: the group is not probed) of least estimated work.

    Work of a group at threshold t: the probes that each fingerprint sends, and the pairs expected to meet. For each
    number of groups, dynamic programming over groups and the sum of thresholds so far finds the best allocation.
    """
    p = np.diag(together) / max(n, 1)
    best: tuple[float, list[list[int]], list[int]] = (math.inf, [], [])
    for parts in range(1, min(most_parts, radius + 2) + 1):
        groups = group_bits(n, together, parts)
        target = radius - parts + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            after: dict[int, tuple[float, list[int]]] = {}
            for t in range(-1, radius + 1):
                probes = sum(math.comb(len(g), d) for d in range(t + 1))
                cost = 0.0 if t < 0 else n * (1 + probes) + n * n / 2 * near_share(p[g], t)
                for so_far, (spent, ts) in table.items():
                    key = so_far + t
                    if key not in after or spent + cost < after[key][0]:
                        after[key] = (spent + cost, [*ts, t])
            table = after
        if target in table and table[target][0] < best[0]:
            best = (table[target][0], groups, table[target][1])
    return best[1], best[2]


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def keys_of(part: int, group: list[int], threshold: int) -> Column:
    """(part, value, indexed) of a fingerprint in a group of bits: its own value, and those within the threshold."""
    value = F.col("fingerprint").bitwiseAND(F.lit(signed(sum(1 << b for b in group))))
    flips = [signed(sum(1 << b for b in bits)) for d in range(1, threshold + 1) for bits in combinations(group, d)]
    key = lambda v, indexed: F.struct(F.lit(part).alias("part"), v.alias("value"), F.lit(indexed).alias("indexed"))
    own = F.array(key(value, True))
    if not flips:
        return own
    return F.concat(own, F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: key(value.bitwiseXOR(x), False)))


def links(distinct: DataFrame, radius: int = 2, bucket_limit: int = 64) -> DataFrame:
    """Edges (u, v), u < v, whose components are those of all pairs of distinct fingerprints within the radius."""
    n, together = bit_statistics(distinct)
    groups, thresholds = plan(n, together, radius)
    probes = [keys_of(k, g, t) for k, (g, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0]
    keyed = distinct.select("fingerprint", F.explode(F.concat(*probes)).alias("s")).select("fingerprint", "s.part", "s.value", "s.indexed")
    sizes = keyed.groupBy("part", "value").agg(F.count("*").alias("size"), F.max("indexed").alias("hit")).where("size > 1 and hit").drop("hit")
    met = keyed.join(sizes, ["part", "value"])
    few = met.where(F.col("size") <= bucket_limit)
    gathered = few.groupBy("part", "value").agg(F.collect_list(F.struct("fingerprint", "indexed")).alias("m"))
    pairs = (
        gathered.select(F.explode("m").alias("x"), "m")  # at most bucket_limit members
        .select("x", F.explode("m").alias("y"))
        .where(F.col("x.indexed") & (F.col("x.fingerprint") != F.col("y.fingerprint")))
        .select(F.least("x.fingerprint", "y.fingerprint").alias("u"), F.greatest("x.fingerprint", "y.fingerprint").alias("v"))
        .where(distance("u", "v") <= radius)
    )
    balls = [F.lit(0).cast("long"), *[F.lit(signed(1 << b)).cast("long") for b in range(BITS)]]
    full = met.where(F.col("size") > bucket_limit).select("fingerprint").distinct()
    at = full.select("fingerprint", F.explode(F.array(*balls)).alias("flip")).select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("key"))
    if radius == 2:
        hub = at.groupBy("key").agg(F.min("fingerprint").alias("hub"), F.max("fingerprint").alias("far")).where("hub < far").drop("far")
        stars = at.join(hub, "key").where("hub < fingerprint").select(F.col("hub").alias("u"), F.col("fingerprint").alias("v"))
    elif radius == 1:  # a ball holds its centre; only links to a centre that is a member count
        stars = at.join(full.select(F.col("fingerprint").alias("key")), "key").where("key <> fingerprint").select(F.least("key", "fingerprint").alias("u"), F.greatest("key", "fingerprint").alias("v"))
    else:
        stars = pairs.limit(0)
        if radius != 0:
            raise ValueError("radius is 0, 1 or 2")
    return pairs.union(stars).distinct()


def stars(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v): each node v that isn't the smallest of its component of edges (u, v), u < v, and that smallest u.

    Alternates large-star and small-star steps; each round is cut by checkpoint() and moves only edges, so a lost
    executor repeats one round. Edges are settled if no node stands below two others or both above and below; edges that
    come so need no round. Few edges are kept in few partitions. Raises if the last round still left others.
    """
    checkpoint_dir(edges.sparkSession)
    current = edges.select("u", "v").checkpoint()
    side = lambda node, above: F.struct(F.col(node).alias("node"), above.alias("above"))
    for _ in range(rounds):
        ends = current.select(F.explode(F.array(side("v", F.col("u")), side("u", F.when(F.lit(False), F.col("u"))))).alias("e")).select("e.node", "e.above")
        nodes = ends.groupBy("node").agg(F.min("above").alias("low"), F.max("above").alias("high"), F.count("above").alias("k"), F.count("*").alias("n"))
        unsettled, n = nodes.agg(F.count_if(F.expr("low < high or k > 0 and k < n")), F.sum("k")).first()
        if not unsettled:
            break
        parts = max(2, math.ceil(n / PART))
        both = current.coalesce(parts).select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u < v").distinct()
        current = small.coalesce(parts).checkpoint()
    else:
        raise RuntimeError("components did not settle")
    return current


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of the component; nodes without an edge are absent."""
    current = stars(edges, rounds)
    named = current.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return named.union(current.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def classify(marks: DataFrame, radius: int = 2, bucket_limit: int = 64) -> DataFrame:
    """(fingerprint, root, component_id) for each distinct fingerprint of `marks` (doc_id, fingerprint)."""
    checkpoint_dir(marks.sparkSession)
    distinct = marks.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).checkpoint()
    found = components(links(distinct, radius, bucket_limit))
    rooted = distinct.join(found, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")).checkpoint()
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of each row of docs."""
    checkpoint_dir(docs.sparkSession)
    marks = fingerprints(docs).checkpoint()
    return marks.join(classify(marks, radius), "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, radius: int = 2) -> DataFrame:
    """The rows of docs without near-duplicates of a kept one: of each component the row of smallest doc_id.

    Of rows that repeat a doc_id in one component one stays (the smallest text hash). Rows without doc_id go where their
    component has a row with one, else the smallest text hash stays. All columns pass.
    """
    checkpoint_dir(docs.sparkSession)
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("__hash"))
    marks = fingerprints(marked, keys=("doc_id", "__hash")).checkpoint()
    return keep_first(docs, marks.join(classify(marks, radius), "fingerprint").select("doc_id", "__hash", "root"))


def keep_first(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The first row of docs of each root; rooted: doc_id, __hash (of the text) and root of each row.

    Rows travel as one struct, so that their columns' names meet no others. The rows to drop are broadcast if they are few.
    """
    ordered = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__hash")
    best = rooted.groupBy("root").agg(F.min(ordered).alias("b")).select(F.col("b.doc_id").alias("__id"), F.col("b.__hash").alias("__h"))
    rows = rooted.groupBy("doc_id", "__hash").agg(F.count("*").alias("__rows"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h"))
    judged = rows.join(best, same, "left").select("doc_id", "__hash", "__rows", F.col("__h").isNotNull().alias("__best")).where("not __best or __rows > 1").checkpoint()
    named = judged.select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__h"), "__best")
    boxed = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col("doc_id"), F.xxhash64("text").alias("__hash"))
    unbox = [F.col("row").getField(c).alias(c) for c in docs.columns]
    kept = boxed.join(few(named), same, "left_anti").select(*unbox)
    repeated = named.where("__best")
    if repeated.limit(1).count() == 0:
        return kept
    once = boxed.join(few(repeated), same).groupBy("__id", "__h").agg(F.min("row").alias("row"))
    return kept.union(once.select(*unbox))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
