"""Token counts in delta-maintained rollups.

Totals of documents and tokens by source, language and tokenizer version are sums of signed deltas: an insert adds, a
delete takes away, a revised count takes the old one away and adds the new one. Each batch of changes is summed (partly
before the shuffle, so a hot source is a row per task) and committed as a small table of its own, named by the batch.
A batch counts once its _SUCCESS marker stands; committing a batch that stands does nothing, and one that was cut short
is written anew, so batches can be sent again. `compact` sums committed batches into a snapshot with the list of what it
holds, written before its own marker; totals read the newest snapshot and the batches that it lacks. A compaction removes
the batches that the snapshot before it held already, and the snapshots before that one, so whoever reads while one runs
still finds what it has listed. A compaction that was cut short has no marker: it is not read, and the next one goes beyond
it. The list of what a snapshot holds is a table; the driver sees only the names of batches that are still there. One
process commits or compacts at a time; two that commit the same batch at once may both write it, and the last one counts.

Counts of a tokenizer version are a caller's column (`n_tokens` of `bpe.encode`, say), or by one of PATTERNS.

Defined results: null text has no tokens but is a document; null source, language or version are keys of their own;
totals in which documents and tokens are both zero are left out; an empty batch is committed and changes nothing; rows
that repeat count each time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import quote
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import checkpoint_dir

KEYS = ("source", "lang", "tokenizer_version")

#: Counters by tokenizer version, as patterns whose matches are tokens.
PATTERNS: Mapping[str, str] = {"words-1": r"[^ \t\n\r\f\x0B]+", "pieces-2": r"[A-Za-z]+|[0-9]|[^A-Za-z0-9 \t\n\r\f\x0B]"}


def token_count(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[version])), F.lit(0)).cast("long")


def change(docs: DataFrame, sign: int, version: str, tokens: Column | None = None) -> DataFrame:
    """Signed rows (keys, docs, tokens) for inserts (1) or deletes (-1) of docs under a tokenizer version.

    tokens: the documents' counts under that version, where it isn't one of PATTERNS; null counts 0.
    """
    n = token_count(F.col("text"), version) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    return docs.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(sign).cast("long").alias("docs"), (sign * n).alias("tokens"))


def revise(docs: DataFrame, old: str, new: str, counts: tuple[Column, Column] | None = None) -> DataFrame:
    """Signed rows that replace the counts of docs by those of another tokenizer version; counts: under both, as above."""
    n = [token_count(F.col("text"), v) for v in (old, new)] if counts is None else [F.coalesce(c, F.lit(0)).cast("long") for c in counts]
    both = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).cast("long").alias("s"), (s * c).alias("n")) for v, s, c in ((old, -1, n[0]), (new, 1, n[1]))])
    return docs.select("source", "lang", F.explode(both).alias("c")).select("source", "lang", F.col("c.v").alias("tokenizer_version"), F.col("c.s").alias("docs"), F.col("c.n").alias("tokens"))


class Rollups:
    """A store of committed batches below a path that Spark reaches."""

    SCHEMA = "source string, lang string, tokenizer_version string, docs long, tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        """What is committed below a folder, oldest name first."""
        top = self._Path(f"{self.path}/{kind}")
        if not self._fs.exists(top):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(top) if s.isDirectory()]
        return sorted(n for n in names if self._fs.exists(self._Path(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add a batch of signed rows; False if it was committed before."""
        name = quote(batch, safe="")
        if name in self._names("batches") or self._held([name]):
            return False
        sums = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batches/{name}")
        return True

    def _newest(self) -> str | None:
        """The newest snapshot's name."""
        return next(reversed(self._names("manifests")), None)

    def _manifest(self, name: str) -> DataFrame:
        return self.spark.read.schema("batch string").parquet(f"{self.path}/manifests/{name}")

    def _held(self, names: list[str], snapshot: str | None = None) -> set[str]:
        """Which of some batches a snapshot (the newest) holds."""
        snapshot = snapshot or self._newest()
        return {r["batch"] for r in self._manifest(snapshot).where(F.col("batch").isin(names)).distinct().collect()} if snapshot and names else set()

    def _sum(self, frames: list[DataFrame]) -> DataFrame:
        every = self.spark.createDataFrame([], self.SCHEMA)
        for f in frames:
            every = every.unionByName(f)
        return every.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def _parts(self) -> tuple[list[DataFrame], list[str]]:
        """What totals are the sum of, and the batches that the newest snapshot lacks."""
        read, newest = self.spark.read.schema(self.SCHEMA), self._newest()
        there = self._names("batches")
        held = self._held(there, newest)
        fresh = [n for n in there if n not in held]
        frames = [read.parquet(f"{self.path}/snapshots/{newest}")] if newest else []
        if fresh:
            frames.append(read.parquet(*[f"{self.path}/batches/{n}" for n in fresh]))
        return frames, fresh

    def totals(self) -> DataFrame:
        """Totals over all committed batches."""
        return self._sum(self._parts()[0])

    def compact(self) -> None:
        """Sum what is committed into a new snapshot; what only older ones need is then removed."""
        before, older = self._newest(), self._names("manifests")[:-1]
        done = self._held(self._names("batches"), before)
        frames, fresh = self._parts()
        name = f"{int(before.partition('-')[0]) + 1 if before else 1:012d}-{uuid4().hex}"
        self._sum(frames).write.parquet(f"{self.path}/snapshots/{name}")
        names = self.spark.createDataFrame([(n,) for n in fresh], "batch string")
        (names.unionByName(self._manifest(before)) if before else names).coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        for n in done:
            self._fs.delete(self._Path(f"{self.path}/batches/{n}"), True)
        for n in older:
            for kind in ("manifests", "snapshots"):
                self._fs.delete(self._Path(f"{self.path}/{kind}/{n}"), True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four deliveries: all documents inserted; every fourth recounted by another tokenizer; of each eight
    one deleted; the recount sent again. The remainders say what changes; the first batch reads all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    store = Rollups(spark, f"{checkpoint_dir(spark)}/rollups-{uuid4().hex}")
    recount = revise(docs.where(F.pmod("doc_id", F.lit(4)) == 0), "words-1", "pieces-2")
    store.commit("insert", change(docs, 1, "words-1"))
    store.commit("recount", recount)
    store.commit("delete", change(docs.where(F.pmod("doc_id", F.lit(8)) == 1), -1, "words-1"))
    store.commit("recount", recount)
    store.compact()
    return store.totals()


SQL = r"""
WITH held AS (
  SELECT source, lang, text, ((doc_id % 8) + 8) % 8 AS r FROM documents
), counted AS (
  SELECT source, lang, 'words-1' AS tokenizer_version, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+')) AS n
  FROM held WHERE r IS NULL OR r NOT IN (0, 4, 1)
  UNION ALL
  SELECT source, lang, 'pieces-2', len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]|[^A-Za-z0-9 \t\n\r\f\x0B]'))
  FROM held WHERE r IN (0, 4)
)
SELECT source, lang, tokenizer_version, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS tokens
FROM counted GROUP BY source, lang, tokenizer_version
"""
