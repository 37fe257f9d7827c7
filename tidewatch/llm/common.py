"""Shared plumbing of the training-data operators: tables and the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a temporary folder; a cluster
    session is an error, as no machine-local folder would do there.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='tidewatch-')}"
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended; what remains lies in the shared folder only
        pass


def strings(column: pa.Array, rows: int = 64) -> Iterator[str | None]:
    """A column's values, of which so many rows at a time become Python's."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def hand_back() -> None:
    """Hands memory that a worker has freed back to the system, where its allocators can; for a task's end."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Has Spark delete a query's shuffle files when the query ends, and not when the driver's JVM happens to collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files; a frame that is run once more would make its own anew."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


#: Rows of small columns that one task handles at least, where a count is known.
ROWS_PER_FILE = 100_000


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.count = 0
        self.kept: list[tuple[DataFrame, str]] = []
        atexit.register(delete, spark, self.base)

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Writes df and returns a frame that reads the written files.

        rows: a bound on df's rows, from a count; it limits the files, and so the tasks of
        later steps, to one for each ROWS_PER_FILE rows.
        """
        self.count += 1
        if rows is not None:
            df = df.coalesce(1 + rows // ROWS_PER_FILE)
        path = f"{self.base}/{self.count}"
        with shuffles_released(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((back, path))
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Removes tables of keep() that nothing reads any more."""
        for frame, path in [k for k in self.kept if any(k[0] is f for f in frames)]:
            delete(self.spark, path)
            self.kept = [k for k in self.kept if k[0] is not frame]

    def drop_all_but(self, *frames: DataFrame) -> None:
        """Removes the tables of keep() but those of frames."""
        self.drop(*(k[0] for k in self.kept if not any(k[0] is f for f in frames)))


def word_count(text):
    """Words of a text column, 0 for null: whole runs of non-separators."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Ids that among() broadcasts at most: 8 bytes each, some 60 MB as a hash table.
BROADCAST_IDS = 1_000_000


def among(frame: DataFrame, ids: DataFrame, on: str, how: str = "left_semi", most: int = BROADCAST_IDS) -> DataFrame:
    """The rows of frame whose value of on is in ids (left_anti: isn't), a written table of distinct longs.

    Ids that a count proves to be most of them or fewer are broadcast, so that frame isn't shuffled; more are joined.
    """
    few = ids.limit(most + 1).count() <= most
    return frame.join(F.broadcast(ids) if few else ids, on, how)


#: Rows of a small table, of some tens of bytes each, that small() broadcasts at most.
SMALL_ROWS = 100_000


def small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if a count proves it small."""
    return F.broadcast(table) if table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else table
