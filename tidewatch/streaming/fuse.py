"""Live containment: a keyed stream of scores, one statistic for each path, trips with evidence.

Scores can come raw: a Reference of benign scores turns them into shares of it before they
reach their path. Observations before a path's last time go to the dead letters; with
strict they fail the stream. A control row with reset set clears its path; a time in resets
clears every path at its first observation from then on. With stop_on_trip a path ends with
its first trip. State lives in RocksDB and can have a time to live; `values()` reads it.
Paths are dealt into buckets by a hash, and a bucket's rows of a micro-batch are worked on
together; each of its paths has an entry of its own in the bucket's state, and only those
that have rows are read and written. The number of buckets stays as long as the checkpoint. A
stream that is started again from its checkpoint with another Fuse keeps the paths' states,
so references and resets change between two micro-batches. Rows out of order within a
micro-batch are put in order, for which a bucket's rows of one micro-batch are held (a path's,
without buckets).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import make_statistic
from ..operators.stats import stepper
from .reference import Reference

EVIDENCE = 10
NUMBERS = ["value", "level", "slope", "p00", "p01", "p10", "p11"]
STATE = f"first boolean, {', '.join(f'{n} double' for n in NUMBERS)}, last double, turn long, epoch long, stopped boolean"
OUT = "path string, t double, seq long, raw double, score double, reference long, stat_name string, stat_value double, threshold double, tripped boolean, turn_index long, evidence array<struct<t: double, score: double, stat_value: double>>, late boolean"
SEEN = "array<struct<t: double, score: double, stat_value: double>>"
NAMES = "path t seq raw score reference stat_name stat_value threshold tripped turn_index evidence late".split(" ")


@dataclass(frozen=True)
class Fuse:
    """What a stream of scores is watched with; threshold overrides the statistic's own.

    buckets: how many groups paths are dealt into, or None for each path on its own.
    """

    statistic: str = "i2t"
    threshold: float | None = None
    reset_on_trip: bool = True
    strict: bool = False
    ttl_ms: int | None = None
    options: dict = field(default_factory=dict)
    normalizer: Reference | None = None
    resets: tuple[float, ...] = ()
    stop_on_trip: bool = False
    buckets: int | None = 512

    def watch(self, scores: DataFrame) -> DataFrame:
        """scores: a stream or table of (path, t, seq, score, reset); the result has a row for each observation.

        raw is the score as it came, score what the statistic got. Observations before the
        last, and those without time or score, are dead letters: late, without a value. A
        path that has stopped has no further rows.
        """
        rows = scores.select(F.col("path").cast("string"), F.col("t").cast("double"), F.col("seq").cast("long"), F.col("score").cast("double").alias("raw"), (F.col("reset") if "reset" in scores.columns else F.lit(False)).alias("reset"))
        rows = self.normalizer.placed(rows, "raw", "score") if self.normalizer else rows.withColumn("score", F.col("raw"))
        kind, key = _Watch, "path"
        if self.buckets:
            kind, key = _Buckets, "_bucket"
            rows = rows.withColumn(key, F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int"))
        return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=kind(self, self.normalizer.version if self.normalizer else None), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime" if self.ttl_ms else "None")


class _Watch(StatefulProcessor):
    def __init__(self, fuse: Fuse, version: int | None):
        self.fuse, self.version = replace(fuse, resets=tuple(sorted(fuse.resets)), normalizer=None), version

    def init(self, handle: StatefulProcessorHandle) -> None:
        stat = make_statistic(self.fuse.statistic, **self.fuse.options)
        self.make, self.start = stepper(stat), stat.start
        self.threshold = self.fuse.threshold if self.fuse.threshold is not None else stat.threshold
        self._states(handle)

    def _states(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE, ttlDurationMs=self.fuse.ttl_ms)
        self.recent = handle.getListState("recent", "t double, score double, stat_value double", ttlDurationMs=self.fuse.ttl_ms)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        parts = list(rows)
        columns = self._columns(parts)
        held = self.state.get()
        recent = [] if held is None else [tuple(r) for r in self.recent.get()]
        order = self._order(columns)
        state, recent, out = self._follow(key[0], held, recent, zip(*(c[order].tolist() for c in columns)))
        self.state.update(state)
        if recent:
            self.recent.put(recent)
        if out:
            yield self._frame(out)

    @staticmethod
    def _columns(parts: list) -> list:
        import numpy as np

        # A path has few rows in a micro-batch, so plain lists are quicker here than frames.
        return [np.concatenate([p[c].to_numpy() for p in parts]) for c in ("t", "seq", "raw", "score", "reset")]

    @staticmethod
    def _order(columns: list, *first):
        """Places by first, time and tie-break."""
        import numpy as np

        return np.lexsort((columns[1].astype(float) if columns[1].dtype == object else columns[1], columns[0].astype(float), *first))

    @staticmethod
    def _frame(out: list[tuple]):
        import pandas as pd

        return pd.DataFrame({n: pd.array(v, "Int64") if n in ("reference", "turn_index") else list(v) for n, v in zip(NAMES, zip(*out))})

    def _follow(self, path: str, held: tuple | None, recent: list[tuple], rows: Iterator[tuple]) -> tuple[tuple, list[tuple], list[tuple]]:
        """Follows a path over its rows in order; its state and last observations from then on, and the rows of the result."""
        fuse = self.fuse
        kept, last, turn, epoch, stopped = None, None, 0, 0, False
        if held is not None:
            first, *numbers, last, turn, epoch, stopped = held
            kept = {"first": first} | {k: v for k, v in zip(NUMBERS, numbers) if k in ("value", *self.start)}
        update, reset = self.make(kept)
        version, out = self.version, []
        for t, seq, raw, score, control in rows:
            if stopped and not control:
                continue
            if control:
                reset()
                last, stopped = None, False
                continue
            late = t is None or score is None or t != t or score != score or last is not None and t < last
            if late:
                if fuse.strict and last is not None and t < last:
                    raise ValueError(f"path {path}: time {t} is before {last}")
                # A dead letter, which leaves the state as it is.
                out.append((path, t, seq, raw, score, version, fuse.statistic, None, self.threshold, False, None, None, True))
                continue
            now = bisect_right(fuse.resets, t)
            if now > epoch:
                reset()
                epoch, last = now, None
            value = update(float(score), 1.0 if last is None else max(0.0, t - last))
            last, tripped = t, value >= self.threshold
            recent = [*recent, (t, float(score), value)][-EVIDENCE:]
            evidence = [{"t": a, "score": b, "stat_value": c} for a, b, c in recent] if tripped else None
            out.append((path, t, seq, raw, score, version, fuse.statistic, value, self.threshold, bool(tripped), turn, evidence, False))
            turn += 1
            stopped = bool(tripped) and fuse.stop_on_trip
            if tripped and fuse.reset_on_trip:
                reset()
        s = update.state
        state = (bool(s["first"]), *(float(s.get(k, 0.0)) for k in NUMBERS), None if last is None else float(last), int(turn), int(epoch), stopped)
        return state, recent, out

    def close(self) -> None:
        pass


class _Buckets(_Watch):
    """Many paths behind one key: frames are made for a bucket, not for each path, and a path's state is one entry."""

    def _states(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("state", "path string", f"{STATE}, recent {SEEN}", ttlDurationMs=self.fuse.ttl_ms)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        parts = list(rows)
        columns = self._columns(parts)
        codes, paths = pd.factorize(np.concatenate([p["path"].to_numpy() for p in parts]), use_na_sentinel=True)
        order = self._order(columns, codes)
        columns, codes, made = [c[order].tolist() for c in columns], codes[order], []
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        for low, high in zip(cuts, cuts[1:]):
            path = None if codes[low] < 0 else paths[codes[low]]  # rows without a path are one path
            held = self.state.getValue((path,))
            recent = [] if held is None else [tuple(r) for r in held[-1] or []]
            state, recent, out = self._follow(path, None if held is None else tuple(held)[:-1], recent, zip(*(c[low:high] for c in columns)))
            self.state.updateValue((path,), (*state, recent))
            made += out
        if made:
            yield self._frame(made)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in a local session without it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='tidewatch-stream-')}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of this module's own, if the session still runs."""
    if spark.sparkContext._jsc is None:
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def values(spark: SparkSession, checkpoint: str, fuse: Fuse | None = None, now: float | None = None) -> DataFrame:
    """(path, value, turns, stopped) of all paths, from a stream's checkpoint by Spark's state reader.

    Paths that were never seen have no row; their value is 0. With fuse and now, paths that a
    reset of all is due for have the value 0.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    state = spark.read.format("statestore").option("stateVarName", "state").load(checkpoint)
    due = bisect_right(sorted(fuse.resets), now) if fuse and now is not None else 0
    # With buckets, a path is an entry of its bucket's map.
    key, held = ("user_map_key", "user_map_value") if "user_map_key" in state.columns else ("key", "value")
    value = F.when(F.col(f"{held}.epoch") < due, F.lit(0.0)).otherwise(F.col(f"{held}.value"))
    return state.select(F.col(f"{key}.path").alias("path"), value.alias("value"), F.col(f"{held}.turn").alias("turns"), F.col(f"{held}.stopped").alias("stopped"))


class Replay:
    """A table of scores, streamed through a Fuse in parts of ascending time.

    Each part is one micro-batch of a stream that starts again from its checkpoint, and may
    have a Fuse of its own. The folder goes when the process ends.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.base = f"{folder or shared_folder(spark)}/{uuid.uuid4().hex}"
        self.out, self.checkpoint = f"{self.base}/out", f"{self.base}/state"
        atexit.register(remove, spark, self.base)

    def feed(self, part: DataFrame, fuse: Fuse, sink: Callable[[DataFrame, int], None] | None = None) -> None:
        """Streams one more part; sink gets the micro-batch and its number instead of the folder of results."""
        part.write.mode("append").parquet(f"{self.base}/in")
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        stream = self.spark.readStream.schema(part.schema).option("pathGlobFilter", "*.parquet").parquet(f"{self.base}/in")
        seen = fuse.watch(stream).writeStream.option("checkpointLocation", self.checkpoint).trigger(availableNow=True)
        query = seen.foreachBatch(sink).start() if sink else seen.format("parquet").option("path", self.out).start()
        query.awaitTermination()

    def seen(self) -> DataFrame:
        return self.spark.read.parquet(self.out)


def parts_by_time(scores: DataFrame, parts: int = 3) -> list[DataFrame]:
    """Parts of ascending time of about one size; rows of null time are in the first."""
    cuts = [None, *scores.approxQuantile("t", [k / parts for k in range(1, parts)], 0.01), None]
    out = []
    for low, high in zip(cuts, cuts[1:]):
        part = scores if low is None else scores.filter(F.col("t") >= low)
        out.append(part if high is None else part.filter((F.col("t") < high) | (F.col("t").isNull() if low is None else F.lit(False))))
    return out


def replay(scores: DataFrame, statistic: str = "i2t", folder: str | None = None, batches: int = 3, sink: Callable[[DataFrame, int], None] | None = None, fuse: Fuse | None = None, **options) -> Replay:
    """Streams a table of (path, t, seq, score) through a Fuse, part by part, until all is read."""
    fuse = fuse or Fuse(statistic, options=options)
    run = Replay(scores.sparkSession, folder)
    for part in parts_by_time(scores, batches):
        run.feed(part, fuse, sink)
    return run
