"""Session settings that several operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below sf_dir, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a temporary one only where the session names none and has no other machines."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not named and not local(spark):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="leafmill-"))
    return named or spark.sparkContext.getCheckpointDir()


def local(spark: SparkSession) -> bool:
    """If driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def quoted(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_rows(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *used: str) -> DataFrame:
    """mapInArrow with the columns and types of rows, under any names; run finds the used columns by their names."""
    numbered = rows.toDF(*[c if c in used else f"__{k}" for k, c in enumerate(rows.columns)])
    return numbered.mapInArrow(run, numbered.schema).toDF(*rows.columns)


_resident: dict = {}


def resident(key: object, make: Callable[[], object]) -> object:
    """This worker's object of that key, made once; it keeps one at a time, so that models of several operators don't add up."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def few(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """rows, to be broadcast if they are at most so many, which is counted; beyond that Spark shuffles them."""
    return F.broadcast(rows) if rows.count() <= most else rows


def stored(rows: DataFrame) -> DataFrame:
    """rows, computed once: written as Parquet below the shared folder and read from there."""
    to = f"{checkpoint_dir(rows.sparkSession)}/stored-{uuid4().hex}"
    rows.write.parquet(to)
    return rows.sparkSession.read.schema(rows.schema).parquet(to)


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is made in here go when its action ends, not when the driver's JVM happens to collect garbage.

    For DataFrames that run once, as those that are checkpointed; one that runs twice has its shuffles made again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session; they need not have it on their path."""
    context = spark.sparkContext
    if getattr(context, "_leafmill_shipped", False):
        return
    top = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="leafmill-")) / "leafmill.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(to))
    context._leafmill_shipped = True


def small_arrow_batches(spark: SparkSession, size: str = "8m") -> None:
    """Make ready for Python workers: bound what one Arrow batch holds, so that long texts cannot fill a worker."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def create(cores: int | str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("leafmill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
