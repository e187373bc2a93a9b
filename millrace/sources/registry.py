"""What a source or a task is, as data: where its rows are, its text, its filter, its tokenizer; and how scorers plug in."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T


def default_text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


@dataclass(frozen=True)
class Source:
    """Rows of a table: which, their text, which of them count, the near-dedup group they share, and bounds."""

    name: str
    rows: Callable[[SparkSession, str], DataFrame]
    text: Callable[[], Column] = default_text
    keep: Callable[[], Column] | None = None
    group: str | None = None
    max_chars: int = 100_000
    limit: int | None = None


def stream_documents(spark: SparkSession, d: str, source: Source) -> DataFrame:
    """doc_id, source, grp, text: filter, then text, non-empty, cut to the greatest length, limit; the order is part of the meaning."""
    rows = source.rows(spark, d)
    if source.keep is not None:
        rows = rows.where(F.coalesce(source.keep(), F.lit(False)))
    rows = rows.select("doc_id", F.lit(source.name).alias("source"), F.lit(source.group or source.name).alias("grp"), source.text().alias("text")).where("text <> ''")
    rows = rows.withColumn("text", F.substring("text", 1, source.max_chars))
    return rows if source.limit is None else rows.orderBy("doc_id").limit(source.limit)


def all_documents(spark: SparkSession, d: str, sources: list[Source]) -> DataFrame:
    found = [stream_documents(spark, d, s) for s in sources]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


@dataclass(frozen=True)
class Tokenizer:
    """Text to ids as a column expression, and the id after each document."""

    encode: Callable[[Column], Column] = T.word_ids
    end_id: int = 0

    def with_end(self, text: Column) -> Column:
        return F.concat(self.encode(text), F.array(F.lit(self.end_id)))


Task = Callable[[SparkSession, str], DataFrame]


def load_tasks(spark: SparkSession, d: str, tasks: dict[str, Task], limit: int | None = None) -> DataFrame:
    """Examples of all tasks (task, item_id, ctx, candidates, label), at most ``limit`` of each; a task that can't be loaded is left out with a warning."""
    out = None
    for name, task in tasks.items():
        try:
            rows = task(spark, d).select(F.lit(name).alias("task"), "item_id", "ctx", "candidates", "label")
        except Exception as e:  # whatever keeps one task from loading must not keep the others
            warnings.warn(f"task {name} left out: {e}", stacklevel=2)
            continue
        if limit is not None:
            rows = rows.orderBy("item_id").limit(limit)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no task could be loaded")
    return out


def score_candidates(examples: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]]) -> DataFrame:
    """``examples`` with scores, a number per candidate from an external scorer, which gets whole batches of (context, continuation)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = [(c, k) for c, ks in zip(frame["ctx"], frame["candidates"]) for k in ks]
            found = iter(scorer(asked))
            yield frame.assign(scores=[[float(next(found)) for _ in ks] for ks in frame["candidates"]])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.schema.fields) + ", scores array<double>"
    return examples.mapInPandas(run, ddl)
