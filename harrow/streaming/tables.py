"""Logs that grow, as streams: latest row wins, keyed state with timers, windows, resume by checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from harrow.operators.rounds import latest
from harrow.sources.scratch import folder

#: Batches after which the deltas of a latest-wins table are merged.
MERGE = 10
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def tail(spark: SparkSession, path: str, schema: str, kind: str = "json", per_trigger: int = 1000) -> DataFrame:
    """A folder of append-only files, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def _tables(spark: SparkSession, target: str) -> dict[str, list[int]]:
    """The batches of whole tables below a folder, by kind: full and delta."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs, out = path.getFileSystem(spark._jsc.hadoopConfiguration()), {"full": [], "delta": []}
    if fs.exists(path):
        for f in fs.listStatus(path):
            kind, _, n = f.getPath().getName().partition("-")
            if kind in out and n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
                out[kind].append(int(n))
    return {k: sorted(v) for k, v in out.items()}


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _merged(spark: SparkSession, target: str, upto: int, keys: list[str], order: str) -> DataFrame:
    """The latest rows of the newest full table before batch `upto` and all deltas since, that of `upto` among them. Raises if one is not there or not whole."""
    there = _tables(spark, target)
    full = max((n for n in there["full"] if n < upto), default=-1)
    deltas = range(full + 1, upto + 1)
    if lost := sorted(set(deltas) - set(there["delta"])):
        raise FileNotFoundError(f"{target}/delta-{lost[0]} is not there or not whole, so what came with it would be dropped")
    parts = ([f"{target}/full-{full}"] if full >= 0 else []) + [f"{target}/delta-{n}" for n in deltas]
    d = spark.read.parquet(parts[0])
    for p in parts[1:]:
        d = d.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return latest(d, keys, order)


def upsert_latest(stream: DataFrame, keys: list[str], order: str, target: str, checkpoint: str, merge: int = MERGE) -> StreamingQuery:
    """ST3: the latest row of each key, kept in tables below target; read_latest() reads them.

    A batch writes the latest of its own rows and nothing else, target/delta-<batch>, so its cost follows the batch and not the table; each merge-th one also merges the deltas since the last merge into target/full-<batch>. What two merges have replaced is deleted. A batch that runs again after a failure overwrites its delta and leaves a whole merge as it is.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        there = _tables(own, target)
        if number in there["full"]:
            return
        if number and number - 1 not in (*there["full"], *there["delta"]):
            raise FileNotFoundError(f"{target}/delta-{number - 1} is not there or not whole, so batch {number} would hide what came with it")
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{target}/delta-{number}")
        if (number + 1) % merge == 0:
            _merged(own, target, number, keys, order).write.mode("overwrite").parquet(f"{target}/full-{number}")
            kept = max((n for n in there["full"] if n < number), default=-1)
            for kind, numbers in there.items():
                for n in numbers:
                    if n < kept or (kind == "delta" and n == kept):
                        _drop(spark, f"{target}/{kind}-{n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, target: str, keys: list[str], order: str) -> DataFrame:
    """The table of upsert_latest() as of its last whole batch."""
    there = _tables(spark, target)
    full, delta = max(there["full"], default=-1), max(there["delta"], default=-1)
    if delta <= full:
        if full < 0:
            raise FileNotFoundError(f"no whole table below {target}")
        return spark.read.parquet(f"{target}/full-{full}")
    return _merged(spark, target, delta, keys, order)


class BestAttempt(StatefulProcessor):
    """Keyed state: the best attempt of a key so far, by score and then the later one, and a timer that closes a key without rows for `gap` milliseconds."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "score double, attempt long, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = self.best.get() if self.best.exists() else None
        score, attempt, seen = was or (float("-inf"), -1, -1)
        for x in rows:
            seen = max(seen, int(x["ms"].max()))
            top = x.sort_values(["score", "attempt"]).iloc[-1]
            score, attempt = max((score, attempt), (float(top["score"]), int(top["attempt"])))
        self.best.update((score, attempt, seen))
        if was is None or seen > was[2]:
            if was is not None:
                self.handle.deleteTimer(was[2] + self.gap)
            self.handle.registerTimer(seen + self.gap)
        if was is None or (score, attempt) != tuple(was[:2]):
            yield pd.DataFrame({"key": [str(key[0])], "event": ["best"], "attempt": [attempt], "score": [score]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.best.exists():
            score, attempt, _ = self.best.get()
            self.best.clear()
            yield pd.DataFrame({"key": [str(key[0])], "event": ["closed"], "attempt": [attempt], "score": [score]})

    def close(self) -> None:
        pass


def best_attempts(stream: DataFrame, key: str, at: str, attempt: str, score: str, gap: str, late: str) -> DataFrame:
    """ST4, T7: (key, event, attempt, score): a 'best' row whenever a batch has a better attempt of a key, or one as good and later; a 'closed' row when a key's last row is older than the watermark by the gap (in milliseconds), with which its state goes.

    The state is three numbers a key, whatever the number of its rows. Start the stream with started(), which sets the state store that this needs.
    """
    d = stream.withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", late)
    d = d.select(F.col(key).cast("string").alias("key"), "_t", F.unix_millis("_t").alias("ms"), F.col(attempt).cast("long").alias("attempt"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"))
    return d.groupBy("key").transformWithStateInPandas(statefulProcessor=BestAttempt(int(gap)), outputStructType="key string, event string, attempt long, score double", outputMode="Append", timeMode="EventTime")


def outstanding(asked: DataFrame, done: Callable[[], DataFrame], keys: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """ST5, J5, J6: of a stream of asked rows those whose keys are in no row of done(), as they stand when the batch runs, nor in a batch before; each batch is a table target/delta-<batch>.

    What was asked is remembered by the checkpoint, so a second run over the same rows adds nothing, and new rows add themselves alone. A batch that runs again overwrites its own table. Keys that are null are never done.
    """
    def put(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        left = batch.dropDuplicates(keys).join(done().select(*keys).distinct(), keys, "left_anti")
        before = [n for n in _tables(own, target)["delta"] if n < number]
        if before:
            left = left.join(own.read.parquet(*[f"{target}/delta-{n}" for n in before]).select(*keys), keys, "left_anti")
        left.write.mode("overwrite").parquet(f"{target}/delta-{number}")

    return asked.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def asked_so_far(spark: SparkSession, target: str) -> DataFrame:
    """The rows of outstanding(), with the batch that they came in."""
    d = None
    for n in _tables(spark, target)["delta"]:
        own = spark.read.parquet(f"{target}/delta-{n}").withColumn("batch", F.lit(n))
        d = own if d is None else d.unionByName(own)
    if d is None:
        raise FileNotFoundError(f"no whole batch below {target}")
    return d


def windowed(stream: DataFrame, at: str, size: str, late: str, slide: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts by event-time window. A time without a zone is taken as the session's, since a watermark needs an instant."""
    t = F.col(at).cast("timestamp")
    w = F.window("_t", size, slide) if slide else F.window("_t", size)
    return stream.withColumn("_t", t).withWatermark("_t", late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(stream: DataFrame, at: str, gap: str, late: str, by: str) -> DataFrame:
    """Sessions of a key that end after a gap: the nearest that data has to an idle timeout."""
    return stream.withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", late).groupBy(F.session_window("_t", gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def started(writer: object) -> StreamingQuery:
    """Starts a stream with the state store that keyed state with timers needs; the session's own setting stays."""
    spark = SparkSession.active()
    was = spark.conf.get(_STORE[0])
    spark.conf.set(*_STORE)
    try:
        return writer.start()
    finally:
        spark.conf.set(_STORE[0], was)


def once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now; its result is a table in the shared folder: all batches, or the last one where each is complete."""
    at, done = f"{folder(stream.sparkSession)}/once-{uuid.uuid4().hex}", []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/table/{number}")
        done.append(number)

    started(stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/log").outputMode(mode).trigger(availableNow=True)).awaitTermination()
    if not done:
        return stream.sparkSession.createDataFrame([], stream.schema)
    parts = sorted(set(done))
    return stream.sparkSession.read.parquet(*[f"{at}/table/{n}" for n in (parts[-1:] if mode == "complete" else parts)])
