"""Quality classifier by importance resampling.

Hashed n-gram models, one of target text (documents labelled good), one of raw text (all
documents), give each whole text a log weight: the sum over its n-grams of
log p_target - log p_raw. Documents are sampled without replacement by Gumbel top-k: the k
largest of tempered log weight + Gumbel noise.

N-grams: words, word pairs, byte trigrams, and trigrams over how each word repeats (not lately, the
one before, the one two before, one of the eight before); each kind is a multinomial of its
own, over hashed buckets. N-grams of one text aren't independent, so sums of them are far too sure: a logistic
regression on labelled rows that the models haven't seen, over the weight divided by a power of the
number of n-grams, turns it into log odds of being good. The
noise is added on that scale, so documents of middling odds are drawn by chance. k is the expected number
of documents worth keeping, by these odds over all rows, where losing a good one costs ``cost`` times as much as keeping junk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.logistic import POWERS, logistic
from millrace.llm.worker import owns
from millrace.llm.wordhash import mix, slabs, spans
from millrace.session import bounded_batches, materialise

KIND = 1 << 14
#: First bucket of each kind: words, word pairs, byte trigrams, repetition trigrams; the end of the last.
STARTS = (0, KIND, 2 * KIND, 3 * KIND, 3 * KIND + 64)
SLAB = 1 << 19


def grams(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and text numbers of the n-grams of each kind; A-Z counts as lower case, words lie between ASCII white space."""
    data, _, _, words, of = spans(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    own = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
    own[np.cumsum(sizes + 1) - 1] = -1  # what stands between texts
    found = [((words >> np.uint64(50)).astype(np.int64), of)]
    pair = of[1:] == of[:-1]
    found.append((KIND + (mix(words[:-1] * np.uint64(31) + words[1:])[pair] >> np.uint64(50)).astype(np.int64), of[1:][pair]))
    inside = (own[:-2] == own[2:]) & (own[2:] >= 0)
    wide = data.astype(np.uint32)
    key = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    found.append((2 * KIND + ((key[inside] * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64), own[:-2][inside].astype(np.int64)))
    kind = np.zeros(len(words), np.int64)
    for back in range(8, 0, -1):
        same = (words[back:] == words[:-back]) & (of[back:] == of[:-back])
        kind[back:][same] = min(back, 3)
    three = of[2:] == of[:-2]
    found.append((3 * KIND + (kind[:-2] * 16 + kind[1:-1] * 4 + kind[2:])[three], of[2:][three]))
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(body, good) -> n-gram counts of the partition: bucket, raw, target."""
    owns("quality")
    raw, target = np.zeros(STARTS[-1], np.int64), np.zeros(STARTS[-1], np.int64)
    for batch in batches:
        good = np.array(batch.column(1).to_pylist(), bool)
        for first, texts in slabs(batch.column(0).cast(pa.binary()).to_pylist(), SLAB):
            own = good[first : first + len(texts)]
            for found, of in grams(texts):
                raw += np.bincount(found, minlength=STARTS[-1])
                if own.any():
                    target += np.bincount(found[own[of]], minlength=STARTS[-1])
    used = np.flatnonzero(raw)
    if len(used):
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw by bucket, each kind a multinomial with one added to every count."""
    out = np.zeros(STARTS[-1])
    for lo, hi in zip(STARTS, STARTS[1:]):
        t, r = target[lo:hi] + 1.0, raw[lo:hi] + 1.0
        out[lo:hi] = np.log(t / t.sum()) - np.log(r / r.sum())
    return out


def labelled(labels: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` labelled rows, by hash of identifier: __mr_label, quality, target and half; of several labels of one identifier the worst counts."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__mr_label"))
    known = known.agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).orderBy(F.xxhash64("__mr_label"), "__mr_label").limit(sample)
    return known.select("__mr_label", "quality", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("target"), F.pmod(F.xxhash64("__mr_label", F.lit(3)), F.lit(2)).alias("half"))


def fit(df: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray | None:
    """Log ratios of the two models by bucket, or None without target rows.

    Raw counts cover all of ``df``, target counts the target rows of the first half of ``known``.
    """
    good = known.where("target AND half = 0").select("__mr_label")
    rows = df.select(F.col(id_col).cast("long").alias("__mr_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    flagged = rows.join(F.broadcast(good), rows["__mr_id"] == good["__mr_label"], "left").select("body", F.col("__mr_label").isNotNull().alias("good"))
    totals = flagged.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(STARTS[-1]), np.zeros(STARTS[-1])
    for bucket, a, b in totals.collect():  # a row per bucket at most
        raw[bucket], target[bucket] = a, b
    return log_ratios(raw, target) if target.any() else None


def _score(ratios: np.ndarray, text_col: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("quality")
        for batch in batches:
            weights, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, texts in slabs(batch.column(text_col).cast(pa.binary()).to_pylist(), SLAB):
                for found, of in grams(texts):
                    weights[first : first + len(texts)] += np.bincount(of, weights=ratios[found], minlength=len(texts))
                    n[first : first + len(texts)] += np.bincount(of, minlength=len(texts))
            yield pa.record_batch([*batch.columns, pa.array(weights), pa.array(n)], names=[*names, "__mr_weight", "__mr_grams"])

    return run


def with_weight(df: DataFrame, ratios: np.ndarray | None, text_col: str = "text") -> DataFrame:
    """``df`` with the log weight of each row's whole text as __mr_weight and its number of n-grams as __mr_grams; 0 for texts without any."""
    if ratios is None:
        return df.withColumns({"__mr_weight": F.lit(0.0), "__mr_grams": F.lit(0).cast("long")})
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", __mr_weight double, __mr_grams long"
    return df.mapInArrow(_score(ratios, text_col, df.columns), ddl)


class Line(NamedTuple):
    """log odds = slope * weight / n-grams ^ power + intercept."""

    slope: float = 0.0
    intercept: float = 0.0
    power: float = 0.0

    def odds(self) -> Column:
        return F.col("__mr_weight") / F.pow(F.greatest(F.col("__mr_grams"), F.lit(1)).cast("double"), F.lit(self.power)) * F.lit(self.slope) + F.lit(self.intercept)


def calibrate(scores: DataFrame, known: DataFrame, id_col: str = "doc_id") -> Line | None:
    """The line that turns a log weight into log odds of being good, from the second half of ``known``; None without good or junk rows there."""
    other = known.where("half = 1").select("__mr_label", "quality")
    rows = scores.join(F.broadcast(other), scores[id_col] == other["__mr_label"]).dropDuplicates(["__mr_label"])
    held = np.array([tuple(r) for r in rows.select(F.col("quality") == 1, "__mr_weight", "__mr_grams").collect()], float).reshape(-1, 3)  # bounded by the sample
    if len(set(held[:, 0])) < 2:
        return None
    found = []
    for power in POWERS:
        (line,), loss = logistic((held[:, 1] / np.maximum(held[:, 2], 1.0) ** power)[:, None], held[:, 0].astype(int), 2)
        found.append((loss, Line(float(max(0.0, line[1])), float(line[0]), power)))
    return min(found, key=lambda x: x[0])[1]


def gumbel_key(odds: Column, id_col: str, seed: int) -> Column:
    """Log odds + Gumbel noise that depends on the identifier and the seed only, so a task that runs again draws the same."""
    u = (F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return odds - F.log(-F.log(u))


def kth_largest(keys: DataFrame, column: str, k: int, few: int = 10_000) -> float:
    """The k-th largest value, by histograms that narrow to a range of at most ``few`` rows or 1,024 doubles; equal values come as one row with their count."""
    lo, hi = keys.agg(F.min(column), F.max(column)).first()
    if lo is None or k <= 0:
        return math.inf
    x = F.col(column)
    while True:
        n = keys.where(x.between(lo, hi)).count()
        if n <= few or hi - lo <= 1024 * math.ulp(max(abs(lo), abs(hi))):
            break
        width = (hi - lo) / 256
        place = F.when(x > hi, 256).when(x < lo, -1).otherwise(F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(255))).cast("int")
        counts = dict(keys.groupBy(place.alias("bin")).count().collect())  # at most 258 bins
        above, at = counts.get(256, 0), 255
        while at > 0 and above + counts.get(at, 0) < k:
            above += counts.get(at, 0)
            at -= 1
        slack = 4 * math.ulp(max(abs(lo), abs(hi)))
        lo, hi = max(lo, lo + at * width - slack), min(hi, lo + (at + 1) * width + slack)
    above = keys.where(x > hi).count()
    for value, n in sorted((tuple(r) for r in keys.where(x.between(lo, hi)).groupBy(column).count().collect()), reverse=True):
        above += n
        if above >= k:
            return value
    return lo


def resample(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, keep: int | None = None, cost: float = 20.0, seed: int = 17, kept_only: bool = False
) -> DataFrame:
    """Scores of every row, or with ``kept_only`` the rows of ``df`` that the sampling keeps, unchanged.

    Scores: ``id_col``, log_weight (of the whole text), log_odds, gumbel_key, kept. ``keep``: how many are drawn; None is the
    expected number worth keeping, rounded up: the sum of odds * ``cost`` / (1 + odds * ``cost``). ``sample`` bounds the labelled rows used. Without labelled target rows, or
    without good and junk rows to calibrate by, every row is kept. Null and empty texts weigh 0.
    Rows that repeat an identifier draw the same noise; rows equal to the k-th key all stay. A very long
    text is one group of n-grams like any other. An empty table gives no rows. Clashing names of further
    columns don't matter.
    """
    bounded_batches(df.sparkSession)
    known = materialise(labelled(labels, sample), "labelled")
    ratios = fit(df, known, id_col, text_col)
    slim = df.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col))
    scores = materialise(with_weight(slim, ratios, text_col).select(id_col, "__mr_weight", "__mr_grams"), "weights")
    line = calibrate(scores, known, id_col) if ratios is not None else None
    odds = (line or Line()).odds()
    keyed = scores.select(id_col, F.col("__mr_weight").alias("log_weight"), odds.alias("log_odds"), gumbel_key(odds, id_col, seed).alias("gumbel_key"))
    if keep is None and line is not None:
        keep = math.ceil(keyed.agg(F.sum(1 / (1 + F.exp(-F.col("log_odds") - F.log(F.lit(float(cost))))))).first()[0] or 0)
    cut = -math.inf if keep is None else kth_largest(keyed, "gumbel_key", keep)
    if not kept_only:
        return keyed.withColumn("kept", F.col("gumbel_key") >= cut)
    return with_weight(df, ratios, text_col).where(gumbel_key(odds, id_col, seed) >= cut).select(*(F.col(f"`{c}`") for c in df.columns))
