"""What several operators share: words, names, shared storage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the control characters 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
NEAR = 0.8


def text_of(column: str | Column = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, as they are; empty for a text without words."""
    return F.array_remove(F.split(text, BLANKS), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once, however often the body names it.

    A plain projection below would be merged into the lambdas above it and computed for each
    of their elements.
    """
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset, as in local tests, a folder of our own is set up.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir")
    if at is None:
        at = sc._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if at is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quarry-shared-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new place below the shared folder, in a folder of this application alone."""
    return f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of whatever file system path names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Places of stored tables, by the innermost ``released`` block that they were made in.
_released: list[list[str]] = []


@contextlib.contextmanager
def released(spark: SparkSession):
    """Tables that are stored inside go when the block ends, also when it fails."""
    _released.append([])
    try:
        yield
    finally:
        for at in _released.pop():
            delete(spark, at)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    def gone() -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            delete(spark, path)

    atexit.register(gone)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, lineage cut.

    For tables that a returned DataFrame reads: they stay until a ``released`` block around the
    call ends, or else until the driver's Python does. If that is killed, the application's folder
    below the shared one is left and may be removed.
    """
    spark = df.sparkSession
    at = shared_path(spark, kind)
    if _released:
        _released[-1].append(at)
    else:
        _delete_at_exit(spark, at)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


class Scratch:
    """Tables that go when the block ends, also when it fails.

    Stored ones lie in the shared folder and cut the lineage; cached ones, for small steps between
    them, are made again from stored ones where an executor is lost.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.held = spark, []

    def __enter__(self) -> Scratch:
        return self

    def stored(self, df: DataFrame, kind: str) -> DataFrame:
        """df written and read again."""
        at = shared_path(self.spark, kind)
        self.held.append((None, at))  # what a failed write leaves goes too
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.held[-1] = (out, at)
        return out

    def cached(self, df: DataFrame) -> DataFrame:
        """df held by the executors, in memory or on their disks."""
        out = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.held.append((out, None))
        return out

    def _free(self, table: DataFrame | None, at: str | None) -> None:
        if at is None:
            table.unpersist()
        else:
            delete(self.spark, at)

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for h in [h for h in self.held if any(h[0] is t for t in tables)]:
            self._free(*h)
        self.held = [h for h in self.held if not any(h[0] is t for t in tables)]

    def __exit__(self, *_) -> None:
        for h in self.held:
            self._free(*h)
        self.held = []


#: What drops the things that operators keep in a Python worker between tasks.
kept_in_worker: list = []


def lean(keep: bool = False) -> None:
    """Give back the memory that earlier tasks left in this Python worker, and what operators keep there unless keep.

    Spark's workers serve one operator after the other.
    """
    for drop in [] if keep else kept_in_worker:
        drop()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc alone
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Fewer rows in an Arrow batch for the jobs that run inside; the session's own value comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from wherever the driver did."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
