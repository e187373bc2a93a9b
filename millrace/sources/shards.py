"""Token shards as files of 16-bit integers with a JSON manifest per source: writing, reading windows, holdout, recovery.

Documents are packed densely: each has its end id, and shards end after a fixed number of tokens wherever that falls.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.files import open_fs, write_atomic

WRITTEN = pa.schema([("source", pa.string()), ("shard", pa.int64()), ("file", pa.string()), ("tokens", pa.int64())])


def running_sum(df: DataFrame, group: list[str], order: str, value: Column, block: int = 1 << 16) -> DataFrame:
    """``df`` with lo, the sum of ``value`` over the rows of the group before each one in order of the whole number ``order``.

    Blocks of order are summed first, then rows within a block, so no task sorts all rows of a group.
    """
    keyed = df.withColumns({"__block": F.floor(F.col(order) / F.lit(block)), "__value": value})
    blocks = keyed.groupBy(*group, "__block").agg(F.sum("__value").alias("__all"))
    before = blocks.withColumn("__before", F.coalesce(F.sum("__all").over(Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__all")
    inside = F.coalesce(F.sum("__value").over(Window.partitionBy(*group, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return keyed.join(before, [*group, "__block"]).withColumn("lo", F.col("__before") + inside).drop("__block", "__value", "__before")


def pieces(tokens: DataFrame, per_shard: int) -> DataFrame:
    """(source, shard, at, ids): each document's ids cut where shards end; ``tokens`` has source, doc_id, ids."""
    placed = running_sum(tokens, ["source"], "doc_id", F.size("ids"))
    n = F.lit(per_shard)
    shards = F.sequence(F.floor(F.col("lo") / n), F.floor((F.col("lo") + F.size("ids") - 1) / n))
    cut = placed.where(F.size("ids") > 0).withColumn("shard", F.explode(shards))
    first = F.greatest(F.lit(0), F.col("shard") * n - F.col("lo")).cast("int")
    end = F.least(F.size("ids"), ((F.col("shard") + 1) * n - F.col("lo")).cast("int"))
    return cut.select("source", "shard", (F.col("lo") + first).alias("at"), F.slice("ids", first + 1, end - first).alias("ids"))


def write_shards(tokens: DataFrame, root: str, per_shard: int) -> DataFrame:
    """Write ``root/<source>/shard_<number>.bin``; a row per file: source, shard, file, tokens. A task that runs again replaces its files whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = str(TaskContext.get().taskAttemptId())
        held, current = [], None

        def done() -> pa.RecordBatch:
            source, shard = current
            data = np.concatenate(held).astype("<u2")
            name = f"shard_{shard:05d}.bin"
            write_atomic(f"{root}/{source}", name, attempt, [data.tobytes()])
            return pa.record_batch([[source], [shard], [name], [len(data)]], schema=WRITTEN)

        for batch in batches:
            for source, shard, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if (source, shard) != current:
                    if current:
                        yield done()
                    held, current = [], (source, shard)
                held.append(ids.values.to_numpy())
        if current:
            yield done()

    dealt = pieces(tokens, per_shard).repartition("source", "shard").sortWithinPartitions("source", "shard", "at")
    return dealt.mapInArrow(run, "source string, shard long, file string, tokens long")


def write_manifests(written: DataFrame, root: str, eos_id: int = 0, extra: dict | None = None) -> DataFrame:
    """``root/<source>/manifest.json`` of every source, written by way of another name; source and total of each."""
    schema = pa.schema([("source", pa.string()), ("total_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = str(TaskContext.get().taskAttemptId())
        for batch in batches:
            sources, totals = batch.column(0).to_pylist(), []
            for source, shards in zip(sources, batch.column(1).to_pylist()):
                listed = [{"file": s["file"], "tokens": s["tokens"]} for s in shards]
                totals.append(sum(s["tokens"] for s in listed))
                data = {"shards": listed, "total_tokens": totals[-1], "dtype": "uint16", "eos_id": eos_id} | (extra or {})
                write_atomic(f"{root}/{source}", "manifest.json", attempt, [json.dumps(data, sort_keys=True).encode()])
            yield pa.record_batch([sources, totals], schema=schema)

    listed = written.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("shard", "file", "tokens"))).alias("shards"))
    return listed.mapInArrow(run, "source string, total_tokens long")


MANIFEST = "shards array<struct<file:string,tokens:bigint>>, total_tokens bigint, dtype string, eos_id int"


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """A row per shard of every manifest below ``root``: source, shard, file, tokens, total_tokens, dtype, eos_id."""
    raw = spark.read.schema(MANIFEST).json(f"{root}/*/manifest.json", multiLine=True).withColumn("source", F.element_at(F.split(F.input_file_name(), "/"), -2))
    return raw.select("source", F.posexplode("shards").alias("shard", "s"), "total_tokens", "dtype", "eos_id").select("source", F.col("shard").cast("long").alias("shard"), "s.file", "s.tokens", "total_tokens", "dtype", "eos_id")


def scan_shards(spark: SparkSession, root: str, manifests: DataFrame) -> DataFrame:
    """(source, shard, ids) of every shard listed; a file that is not as long as its manifest says is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bin").load(root)
    named = files.select(F.element_at(F.split("path", "/"), -2).alias("source"), F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    schema = pa.schema([("source", pa.string()), ("shard", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, shard, tokens, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids = np.frombuffer(content, "<u2").astype(np.int32)
                if len(ids) != tokens:
                    raise ValueError(f"{source} shard {shard} holds {len(ids)} tokens, not {tokens}")
                yield pa.record_batch([[source], [shard], [ids]], schema=schema)

    return named.join(manifests, ["source", "file"]).select("source", "shard", "tokens", "content").mapInArrow(run, "source string, shard long, ids array<int>")


def by_bucket(ranges: DataFrame, points: DataFrame, point: str, width: int, keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Range join of ``points`` with ``ranges`` (lo, hi): both are dealt by coarse buckets of ``width``, so it is an equi-join."""
    keys = keys or []
    wide = ranges.where("hi > lo").withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    at = points.withColumns({"__bucket": F.floor(F.col(point) / width), "__at": F.col(point)})
    p, r = at.alias("p"), wide.alias("r")
    on = [F.col(f"p.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("p.__bucket") == F.col("r.__bucket"), F.col("p.__at") >= F.col("r.lo"), F.col("p.__at") < F.col("r.hi")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return p.join(r, cond, how).select(*(F.col(f"p.{c}") for c in points.columns), *(F.col(f"r.{c}") for c in ranges.columns if c not in keys))


def read_windows(manifests: DataFrame, windows: DataFrame, root: str, size: int, width: int) -> DataFrame:
    """(source, start, ids): ``size`` tokens from each start (source, start), across shards; what lies beyond the end is missing.

    Only the bytes asked for are read, by tasks that hold one window each.
    """
    ends = running_sum(manifests, ["source"], "shard", F.col("tokens"))
    ranges = ends.select("source", "file", "lo", (F.col("lo") + F.col("tokens")).alias("hi"))
    # windows and shards meet in the coarse buckets that both touch
    near = ranges.where("hi > lo").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    asked = windows.select("source", "start").distinct().withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.lit(size - 1)) / width))))
    parts = asked.join(near, ["source", "bucket"]).where((F.col("lo") < F.col("start") + size) & (F.col("hi") > F.col("start"))).select("source", "start", "file", "lo", "hi").distinct()
    schema = pa.schema([("source", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, start, file, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(5))):
                a, b = max(lo, start), min(hi, start + size)
                system, path = open_fs(f"{root}/{source}/{file}")
                with system.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(2 * (b - a), 2 * (a - lo)), "<u2").astype(np.int32)
                yield pa.record_batch([[source], [start], [a], [ids]], schema=schema)

    read = parts.mapInArrow(run, "source string, start long, at long, ids array<int>")
    return read.groupBy("source", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x.ids)).alias("ids"))


def split_holdout(shards: DataFrame, fraction: float) -> DataFrame:
    """``shards`` (source, shard, file, tokens) with held: whole shards from the end until the fraction is reached, never the first, none of a single one."""
    own = Window.partitionBy("source")
    later = F.coalesce(F.sum("tokens").over(own.orderBy(F.desc("shard")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n, total = F.count(F.lit(1)).over(own), F.sum("tokens").over(own)
    held = F.when((n < 2) | (F.col("shard") == 0), F.lit(False)).when(F.col("shard") == n - 1, F.lit(True)).otherwise(later < F.floor(total * fraction))
    return shards.withColumn("held", held)
