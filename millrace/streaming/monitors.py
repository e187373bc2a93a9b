"""Structured Streaming twins: log tail, file watch, keyed dedup, interval gate."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.text import normalize
from millrace.session import shared_path


def drain(df: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote; offsets and state live in the shared folder."""
    spark = df.sparkSession
    out = shared_path(spark, tag)
    df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", shared_path(spark, f"{tag}-offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


class Resumable:
    """A stream of Parquet files with a checkpoint of its own: each ``drain`` takes what has come since the last one."""

    def __init__(self, spark: SparkSession, schema: StructType, path: str, out: str, offsets: str, files: int = 4):
        self.spark, self.schema, self.path, self.out, self.offsets, self.files = spark, schema, path, out, offsets, files

    def drain(self) -> None:
        rows = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files).parquet(self.path)
        rows.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.offsets).trigger(availableNow=True).start().awaitTermination()

    def result(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.out)


def source(spark: SparkSession, sf_dir: str, table: str, files: int = 4) -> DataFrame:
    """A table's files as a stream, at most ``files`` per pass."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{table}.parquet" if _is_dir(spark, f"{sf_dir}/{table}.parquet") else f"{sf_dir}/{table}*.parquet")


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def exact_dedup_stream(docs: DataFrame, ts: str = "ts", keep: str = "1 day") -> DataFrame:
    """First document of each normal form; state is dropped ``keep`` behind the watermark."""
    keyed = docs.withColumn("h", F.sha2(normalize(F.col("text")), 256)).withWatermark(ts, keep)
    return keyed.dropDuplicatesWithinWatermark(["h"])


def interval_gate(events: DataFrame, seconds: int) -> DataFrame:
    """Per user the events that fire: the first, then each that comes ``seconds`` or more after the last fired.

    State: one timestamp per user.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        fired = []
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        for event, at in zip(rows.event_id, rows["at"]):
            if last is None or at - last >= seconds * 1_000_000:
                last = int(at)
                fired.append(event)
        state.update((last,))
        yield pd.DataFrame({"user_id": [key[0]] * len(fired), "event_id": fired})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long", "last long", "append", GroupStateTimeout.NoTimeout)


def divergence_stream(records: DataFrame, window: int = 20, factor: float = 2.0, least: int = 5) -> DataFrame:
    """(run, o) of records (run, o, step, loss) whose loss is no number or above ``factor`` times the mean of up to ``window`` before it in its attempt.

    State per run: the last step and the last losses of the attempt; a step that goes back begins a new one.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, losses = (state.get[0], list(state.get[1])) if state.exists else (None, [])
        found = []
        rows = pd.concat(list(frames)).sort_values("o")
        for o, at, loss in zip(rows.o, rows.step, rows.loss):
            if last is not None and not pd.isna(at) and at < last:
                losses = []
            known = [x for x in losses if x == x]
            mean = sum(known) / len(known) if known else 0.0
            if loss != loss or abs(loss) == float("inf") or (len(known) >= least and mean > 0 and loss > factor * mean):
                found.append(o)
            losses = [*losses, float(loss)][-window:]
            last = None if pd.isna(at) else int(at)
        state.update((last, losses))
        yield pd.DataFrame({"run": [key[0]] * len(found), "o": found})

    return records.groupBy("run").applyInPandasWithState(step, "run long, o long", "last long, losses array<double>", "append", GroupStateTimeout.NoTimeout)


def newest_stream(queue: DataFrame) -> DataFrame:
    """(slot, kind, event_id) whenever a slot has something newer; state: one identifier per slot."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = max(int(f.event_id.max()) for f in frames)
        before = state.get[0] if state.exists else None
        ahead = before is None or newest > before
        if ahead:
            state.update((newest,))
        yield pd.DataFrame({"slot": [key[0]] * ahead, "kind": [key[1]] * ahead, "event_id": [newest] * ahead})

    return queue.groupBy("slot", "kind").applyInPandasWithState(step, "slot long, kind string, event_id long", "newest long", "append", GroupStateTimeout.NoTimeout)


class MutedSink:
    """A sink for ``foreachBatch`` that must not stop the stream: after a failure it rests for ``mute`` seconds, after ``most`` in a row for good.

    ``clock`` may be handed in; ``dropped`` counts batches that were not sent.
    """

    def __init__(self, send: Callable[[DataFrame], None], mute: float = 600.0, most: int = 6, clock: Callable[[], float] = time.monotonic):
        self.send, self.mute, self.most, self.clock = send, mute, most, clock
        self.failures, self.until, self.dropped = 0, 0.0, 0

    def __call__(self, batch: DataFrame, number: int = 0) -> None:
        if self.failures >= self.most or self.clock() < self.until:
            self.dropped += 1
            return
        try:
            self.send(batch)
            self.failures = 0
        except Exception:  # the sink is told apart from the stream by swallowing what it raises
            self.failures += 1
            self.until = self.clock() + self.mute
            self.dropped += 1

