"""LM scoring by a Brown class-based bigram model.

Units are the most frequent words and, for all others, groups by ending. Exchange clustering
moves units between classes as long as the class-bigram likelihood of the training text rises.
Then every other training word goes to the class under which its own occurrences, between the
classes before and after them, are likeliest; only words that training lacks keep the class of
their ending. A word's probability is

    P(w | previous) = mix * P(class | class before) * P(w | class) + (1 - mix) * P(w)

with P(w | class) = (c + 0.1) / (tokens of class + 0.1 * (words of class + 1)), words of a class counted,
and class transitions smoothed towards class frequencies. Counts of words, of classes side by side
and the vocabulary cover every training document; words are 64-bit hashes. Counts and classes of the most
frequent words (at most ``frequent``) reach the later passes as a file; those of all others by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.files import list_files, open_fs
from millrace.llm.wordhash import END, slabs, words
from millrace.session import bounded_batches, materialise, shared_path
from millrace.llm.worker import cache, owns

ALPHA = 0.1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with an end after each text: hash, text number, ending."""
    found, doc, ending = words(texts)
    at = np.searchsorted(doc, np.arange(len(texts)), side="right")
    return np.insert(found, at, END), np.insert(doc, at, np.arange(len(texts))), np.insert(ending, at, END)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(body) -> (h, c), summed for a few million tokens at a time."""
    owns("lm")

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([_signed(values), pa.array(counts.astype(np.int64))], names=["h", "c"])

    held, size = [], 0
    for batch in batches:
        for _, texts in slabs(batch.column(0).cast(pa.binary()).to_pylist()):
            held.append(_stream(texts)[0])
            size += len(held[-1])
            if size > 6_000_000:
                yield out(held)
                held, size = [], 0
    if held:
        yield out(held)


class Units:
    """Word hash and ending to unit: 0 is the end, then the head words, then the groups by ending."""

    def __init__(self, head: list[int], groups: int):
        self.head = np.sort(np.array(head, np.int64).view(np.uint64)) if head else np.zeros(0, np.uint64)
        self.groups = groups
        self.n = 1 + len(self.head) + groups

    def of(self, found: np.ndarray, ending: np.ndarray) -> np.ndarray:
        unit = (1 + len(self.head) + (ending % np.uint64(self.groups))).astype(np.int64)
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, found), len(self.head) - 1)
            unit = np.where(self.head[at] == found, 1 + at, unit)
        return np.where(found == END, 0, unit)


def _pair_counts(units: Units):
    """(body) -> per unit: packed counts of the units after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("lm")
        table = np.zeros(units.n * units.n, np.int64)
        for batch in batches:
            for _, texts in slabs(batch.column(0).cast(pa.binary()).to_pylist()):
                found, _, ending = _stream(texts)
                unit = units.of(found, ending)
                before = np.concatenate([[0], unit[:-1]])  # a text starts after an end
                np.add.at(table, before * units.n + unit, 1)
        table = table.reshape(units.n, units.n)
        used = np.flatnonzero(table.any(axis=1))
        if len(used):
            cells = [np.flatnonzero(table[u]) for u in used]
            yield pa.record_batch([pa.array(used, pa.int32()), pa.array([c.astype(np.uint16).tobytes() for c in cells], pa.binary()), pa.array([table[u][c].astype(np.uint64).tobytes() for u, c in zip(used, cells)], pa.binary())], names=["unit", "after", "counts"])

    return run


def _pair_sums(n: int):
    """Rows of one unit, in order, to one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("lm")
        current, total = None, np.zeros(n, np.int64)

        def out() -> pa.RecordBatch:
            cells = np.flatnonzero(total)
            return pa.record_batch([pa.array([current], pa.int32()), pa.array([cells.astype(np.uint16).tobytes()], pa.binary()), pa.array([total[cells].astype(np.uint64).tobytes()], pa.binary())], names=["unit", "after", "counts"])

        for batch in batches:
            for unit, after, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if unit != current:
                    if current is not None:
                        yield out()
                    current, total = unit, np.zeros(n, np.int64)
                total[np.frombuffer(after, np.uint16)] += np.frombuffer(counts, np.uint64).astype(np.int64)
        if current is not None:
            yield out()

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = 12) -> np.ndarray:
    """Class of each unit: greedy exchange from a start by frequency; unit 0 (the end) stays alone in class 0."""
    n = len(pairs)
    pairs = pairs.astype(float)
    size = pairs.sum(0)
    cls = np.zeros(n, np.int64)
    order = np.argsort(-size, kind="stable")
    order = order[order != 0]
    cls[order] = 1 + np.arange(len(order)) % (classes - 1)
    one = np.eye(classes)[cls]
    after, before = pairs @ one, pairs.T @ one  # per unit: counts by class after and before it
    table = one.T @ after
    out_n, in_n = table.sum(1), table.sum(0)
    for _ in range(sweeps):
        moved = 0
        for u in order.tolist():
            a, own = cls[u], pairs[u, u]
            if not size[u]:
                continue
            fwd, back = after[u].copy(), before[u].copy()
            fwd[a] -= own
            back[a] -= own
            # the table without this unit
            table[a] -= fwd
            table[:, a] -= back
            table[a, a] -= own
            out_n[a] -= fwd.sum() + own
            in_n[a] -= back.sum() + own
            rows = _xlogx(table + fwd) - _xlogx(table)
            cols = _xlogx(table + back[:, None]) - _xlogx(table)
            diag = np.diag(table)
            gain = rows.sum(1) - np.diag(rows) + cols.sum(0) - np.diag(cols) + _xlogx(diag + fwd + back + own) - _xlogx(diag)
            gain -= _xlogx(out_n + fwd.sum() + own) - _xlogx(out_n) + _xlogx(in_n + back.sum() + own) - _xlogx(in_n)
            gain[0] = -np.inf
            b = int(np.argmax(gain)) if gain.max() > gain[a] + 1e-6 else int(a)
            table[b] += fwd
            table[:, b] += back
            table[b, b] += own
            out_n[b] += fwd.sum() + own
            in_n[b] += back.sum() + own
            if b != a:
                moved += 1
                cls[u] = b
                after[:, a] -= pairs[:, u]
                after[:, b] += pairs[:, u]
                before[:, a] -= pairs[u]
                before[:, b] += pairs[u]
        if moved <= len(order) // 1000:
            break
    return cls


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values: the bytes of ``values`` between each two of ``cuts``."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _neighbour_counts(units: Units, cls: np.ndarray, classes: int, most: int = 1_500_000):
    """(body) -> (h, at, cells, counts), a row per word in no unit of its own and some ``most`` neighbours: at is the class of its ending; a cell is the class before it, the class after it plus the number of classes, or twice that number where the word follows itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("lm")
        width = 2 * classes + 1

        def out(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            every, own, cell = (np.concatenate(x) for x in zip(*held))
            h, first, at = np.unique(every, return_index=True, return_inverse=True)
            keys, c = np.unique(at * width + cell, return_counts=True)
            cuts = np.searchsorted(keys, np.arange(len(h) + 1) * width)
            return pa.record_batch([_signed(h), pa.array(own[first].astype(np.int32)), _packed((keys % width).astype(np.uint16), cuts), _packed(c.astype(np.uint32), cuts)], names=["h", "at", "cells", "counts"])

        held, size = [], 0
        for batch in batches:
            for _, texts in slabs(batch.column(0).cast(pa.binary()).to_pylist()):
                found, _, ending = _stream(texts)
                unit = units.of(found, ending)
                of, at = cls[unit], np.flatnonzero(unit > len(units.head))
                before = np.where(at > 0, found[at - 1], END)
                same, again = before == found[at], found[at + 1] == found[at]  # a text ends with an end, so there is a next one
                held.append((found[at], of[at].astype(np.int16), np.where(same, 2 * classes, np.where(at > 0, of[at - 1], cls[0])).astype(np.int16)))
                held.append((found[at[~again]], of[at[~again]].astype(np.int16), (classes + of[at[~again] + 1]).astype(np.int16)))
                size += 2 * len(at)
                if size > most:
                    yield out(held)
                    held, size = [], 0
        if size:
            yield out(held)

    return run


def likeliest(fwd: np.ndarray, back: np.ndarray, own: np.ndarray, at: np.ndarray, table: np.ndarray, weight: float) -> np.ndarray:
    """Class of each word from counts of the classes after and before it and of itself after itself.

    A word's occurrences in class b have the log likelihood sum(back * log P(b | before)) + c * log P(w | b)
    + sum(fwd * log P(after | b)). Its own counts are taken out of ``at``, the class they are in so far. Class 0 is the end's alone.
    """
    size, c = table.sum(0), back.sum(1) + own
    prior = (size + 0.5) / (size + 0.5).sum()
    step = np.log((table + weight * prior) / (table.sum(1, keepdims=True) + weight))
    score = fwd @ step.T + back @ step + own[:, None] * np.diag(step) - c[:, None] * np.log(size + np.maximum(c, 1)[:, None])
    rows = np.arange(len(at))
    out_of, in_to = fwd.copy(), back.copy()
    out_of[rows, at] += back[rows, at] + own
    in_to[rows, at] += fwd[rows, at] + own
    prior_at = prior[at][:, None]
    after = np.log(np.maximum(table[at] - out_of, 0) + weight * prior) - np.log(np.maximum(table.sum(1)[at] - fwd.sum(1) - own, 0) + weight)[:, None]
    before = np.log(np.maximum(table.T[at] - in_to, 0) + weight * prior_at) - np.log(table.sum(1) + weight)
    score[rows, at] = (fwd * after).sum(1) + (back * before).sum(1) + own * after[rows, at] - c * np.log(np.maximum(size[at], 1))
    score[:, 0] = -np.inf
    return score.argmax(1)


def _assign(table: np.ndarray, weight: float):
    """(h, at, cells, counts) in order of h, any number of rows per word -> (h, k): the class of each word by its neighbours."""
    classes = len(table)
    width = 2 * classes + 1

    def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """All values, and the row of each."""
        parts = column.to_pylist()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(kind).itemsize
        return np.frombuffer(b"".join(parts), kind), np.repeat(np.arange(len(parts)), sizes)

    def out(h: np.ndarray, at: np.ndarray, full: np.ndarray) -> pa.RecordBatch:
        k = likeliest(full[:, classes : 2 * classes], full[:, :classes], full[:, -1], at, table, weight)
        return pa.record_batch([pa.array(h), pa.array(k.astype(np.int32))], names=["h", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("lm")
        last = None  # the word at the end of what was read may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            h, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.concatenate([[True], h[1:] != h[:-1]])
            word, first = np.cumsum(new) - 1, np.flatnonzero(new)
            cells, row = unpacked(batch.column(2), np.uint16)
            counts, _ = unpacked(batch.column(3), np.uint32)
            full = np.bincount(word[row] * width + cells, weights=counts, minlength=len(first) * width).reshape(len(first), width)
            h, at = h[first], at[first]
            if last is not None and last[0][0] == h[0]:
                full[0] += last[2][0]
            elif last is not None:
                yield out(*last)
            if len(h) > 1:
                yield out(h[:-1], at[:-1], full[:-1])
            last = h[-1:].copy(), at[-1:].copy(), full[-1:].copy()
        if last is not None:
            yield out(*last)

    return run


class Classes:
    """Classes of words: from units for the end and head words, from the file for listed ones; for others by ending, and open."""

    def __init__(self, uri: str, units: Units, cls: np.ndarray):
        self.units, self.cls = units, cls
        self.listed, self.counts, self.classes = _frequent(uri)

    def of(self, found: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class, whether it is open, count and whether the file has the word."""
        unit = self.units.of(found, ending)
        of, c, hit = self.cls[unit], np.zeros(len(found), np.int64), np.zeros(len(found), bool)
        if len(self.listed):
            at = np.minimum(np.searchsorted(self.listed, found), len(self.listed) - 1)
            hit = self.listed[at] == found
            c[hit] = self.counts[at[hit]]
            of = np.where(hit & (self.classes[at] >= 0), self.classes[at], of)
        return of, ~hit & (unit > len(self.units.head)), c, hit


def _class_pairs(uri: str, units: Units, cls: np.ndarray, n: int):
    """(body) -> (hp, kp, hc, kc, c): classes side by side; hp and hc are words whose class is open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("lm")
        known = Classes(uri, units, cls)
        table = np.zeros(n * n, np.int64)
        for batch in batches:
            for _, texts in slabs(batch.column(0).cast(pa.binary()).to_pylist()):
                found, _, ending = _stream(texts)
                of, open_, _, _ = known.of(found, ending)
                before, was_open, word = np.concatenate([[cls[0]], of[:-1]]), np.concatenate([[False], open_[:-1]]), np.concatenate([[END], found[:-1]])
                loose = open_ | was_open
                table += np.bincount((before * n + of)[~loose], minlength=n * n)
                if loose.any():
                    yield pa.record_batch(
                        [pa.array(word[loose].view(np.int64), mask=~was_open[loose]), pa.array(before[loose].astype(np.int32)), pa.array(found[loose].view(np.int64), mask=~open_[loose]), pa.array(of[loose].astype(np.int32)), pa.array(np.ones(int(loose.sum()), np.int64))],
                        names=["hp", "kp", "hc", "kc", "c"],
                    )
        cells = np.flatnonzero(table)
        yield pa.record_batch([pa.nulls(len(cells), pa.int64()), pa.array((cells // n).astype(np.int32)), pa.nulls(len(cells), pa.int64()), pa.array((cells % n).astype(np.int32)), pa.array(table[cells])], names=["hp", "kp", "hc", "kc", "c"])

    return run


def _closed(rows: DataFrame, word: str, k: str, words_: DataFrame, count: str | None = None) -> DataFrame:
    """``rows`` with the class in ``k`` of the words in ``word`` from ``words_`` (h, c, k), and their count as ``count``; rows without a word skip the join."""
    found = words_.select(F.col("h").alias("__h"), F.col("k").alias("__k"), F.col("c").alias("__c"))
    names = [c for c in rows.columns if c != k]
    more = [F.col("__c").alias(count)] if count else []
    met = rows.where(F.col(word).isNotNull()).join(found, F.col(word) == F.col("__h"), "left").select(*names, F.coalesce(F.when(F.col("__k") >= 0, F.col("__k")), F.col(k)).alias(k), *more)
    none = rows.where(F.col(word).isNull()).select(*names, k, *([F.lit(None).cast("long").alias(count)] if count else []))
    return met.unionByName(none)


_FREQUENT: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = cache()


def _frequent(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order, counts and classes (-1 for words that are units) of the frequent words, kept per Python worker."""
    if uri not in _FREQUENT:
        parts = []
        for path, _ in list_files(uri, ".parquet"):
            system, name = open_fs(path)
            with system.open_input_file(name) as f:
                parts.append(pq.ParquetFile(f).read(["h", "c", "k"]))
        table = pa.concat_tables(parts) if parts else pa.table({"h": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "k": pa.array([], pa.int32())})
        h, c, k = table["h"].to_numpy().view(np.uint64), table["c"].to_numpy(), table["k"].to_numpy()
        order = np.argsort(h)
        _FREQUENT.clear()
        _FREQUENT[uri] = h[order], c[order], k[order].astype(np.int16)
    return _FREQUENT[uri]


ROW = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("counted", pa.float64()), ("lift", pa.float64()), ("hp", pa.int64()), ("kp", pa.int32()), ("kc", pa.int32())])
ROW_DDL = "row long, id long, h long, n_tokens long, n_known long, counted double, lift double, hp long, kp int, kc int"


def _score(uri: str, units: Units, cls: np.ndarray, lift: np.ndarray, all_listed: bool):
    """(id, body) -> a row per text with its sums, and one (kp set) per pair in which a word is neither listed nor a unit: h and hp are those words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("lm")
        known = Classes(uri, units, cls)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in slabs(batch.column(1).cast(pa.binary()).to_pylist()):
                found, doc, ending = _stream(texts)
                n = len(texts)
                of, open_, c, hit = known.of(found, ending)
                if all_listed:
                    hit, open_ = np.ones(len(found), bool), np.zeros(len(found), bool)
                before, was_open, word = np.concatenate([[cls[0]], of[:-1]]), np.concatenate([[False], open_[:-1]]), np.concatenate([[END], found[:-1]])
                loose = open_ | was_open
                lifts = np.bincount(doc, weights=np.where(loose, 0.0, lift[before, of]), minlength=n)
                logs = np.where(hit, np.log10(c + ALPHA), 0.0)
                own = ids[first : first + n]
                yield pa.record_batch(
                    [pa.array(np.arange(row, row + n)), pa.array(own, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc, weights=hit & (c > 0), minlength=n).astype(np.int64)), pa.array(np.bincount(doc, weights=logs, minlength=n)), pa.array(lifts), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())],
                    schema=ROW,
                )
                rest = np.flatnonzero(loose | ~hit)
                if len(rest):
                    zero, m = np.zeros(len(rest)), len(rest)
                    yield pa.record_batch(
                        [pa.array(row + doc[rest]), pa.nulls(m, pa.int64()), pa.array(found[rest].view(np.int64), mask=hit[rest]), pa.array(zero.astype(np.int64)), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(np.where(loose, 0.0, 1.0)[rest]), pa.array(word[rest].view(np.int64), mask=~was_open[rest]), pa.array(before[rest].astype(np.int32)), pa.array(of[rest].astype(np.int32))],
                        schema=ROW,
                    )
                row += n

    return run


def lm_scores(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, head: int = 1535, groups: int = 512, classes: int = 64, frequent: int = 1_000_000, mix: float = 0.98, weight: float = 20.0
) -> DataFrame:
    """One row per input row: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on rows whose crc32 of the identifier as text is not 0 modulo ``folds``; a null identifier
    counts as the empty text and so is held out. Null and empty texts are one end token. Rows
    that repeat an identifier are scored on their own. Without training rows all counts are 0 and
    scores equal base scores. ``head``, ``groups`` and ``classes`` are the model's size, ``frequent`` bounds
    the file of counts. Further columns are ignored; an empty table gives no rows.
    """
    bounded_batches(df.sparkSession)
    spark = df.sparkSession
    base = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    held_out = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % folds == 0
    train = base.where(~held_out).select("body")
    counts = materialise(train.mapInArrow(_word_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    bin_of = F.floor(F.log2("c") * 16)
    bins = sorted(((r[0], r[1]) for r in counts.groupBy(bin_of.alias("bin")).count().collect()), reverse=True)  # at most 1,024 bins
    least, listed = None, 0
    for bin_, n in bins:
        if listed + n > frequent:
            break
        least, listed = bin_, listed + n
    top = [r["h"] for r in counts.where(F.col("h") != int(END)).orderBy(F.desc("c"), "h").limit(head).collect()]

    units = Units(top, groups)
    pairs = np.zeros((units.n, units.n), np.int64)
    packed = train.mapInArrow(_pair_counts(units), "unit int, after binary, counts binary").repartition("unit").sortWithinPartitions("unit")
    for unit, after, found in packed.mapInArrow(_pair_sums(units.n), "unit int, after binary, counts binary").toLocalIterator():
        pairs[unit, np.frombuffer(after, np.uint16)] = np.frombuffer(found, np.uint64).astype(np.int64)  # a table of fixed size
    cls = exchange(pairs, classes)

    # every other training word by its own neighbours; so far it has the class of its ending
    one = np.eye(classes)[cls]
    first = one.T @ pairs @ one
    near = train.mapInArrow(_neighbour_counts(units, cls, classes), "h long, at int, cells binary, counts binary")
    assigned = near.repartition("h").sortWithinPartitions("h").mapInArrow(_assign(first, weight), "h long, k int")
    counts = materialise(counts.join(assigned, "h", "left").select("h", "c", F.coalesce("k", F.lit(-1)).alias("k")), "word-classes")
    uri = shared_path(spark, "frequent-words")
    counts.where(bin_of >= (least if least is not None else 1 << 30)).write.parquet(uri)
    side = train.mapInArrow(_class_pairs(uri, units, cls, classes), "hp long, kp int, hc long, kc int, c long")
    if listed < distinct:
        side = materialise(side, "class-pairs")
        side = _closed(_closed(side, "hp", "kp", counts), "hc", "kc", counts)
    table = np.zeros((classes, classes))
    for r in side.groupBy("kp", "kc").agg(F.sum("c").alias("c")).collect():
        table[r["kp"], r["kc"]] = r["c"]
    tokens = table.sum(0)
    words_of = np.bincount(cls[: 1 + len(top)], minlength=classes).astype(float)
    for r in counts.where("k >= 0").groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect():
        words_of[r["k"]] += r["n"]
    lift = np.zeros((classes, classes))
    if total:
        prior = (tokens + 0.5) / (tokens + 0.5).sum()
        follows = (table + weight * prior) / (table.sum(1, keepdims=True) + weight)
        uniform = total + ALPHA * (distinct + 1)
        lift = np.log10(mix * follows * uniform / (tokens + ALPHA * (words_of + 1)) + (1 - mix))

    rows = materialise(base.mapInArrow(_score(uri, units, cls, lift, listed >= distinct), ROW_DDL), "lm-rows")
    lifts = spark.createDataFrame([(i, j, float(lift[i, j])) for i in range(classes) for j in range(classes)], "kp int, kc int, value double")
    loose = rows.where("kp IS NOT NULL").select("row", "h", "hp", "kp", "kc", F.col("lift").alias("done"))
    loose = _closed(_closed(loose, "hp", "kp", counts), "h", "kc", counts, "n").join(F.broadcast(lifts), ["kp", "kc"])
    rare = loose.groupBy("row").agg(
        F.sum(F.when(F.col("h").isNotNull(), F.log10(F.coalesce("n", F.lit(0)) + F.lit(ALPHA))).otherwise(0.0)).alias("rare"), F.count("n").alias("rare_known"), F.sum(F.when(F.col("done") == 0, F.col("value")).otherwise(0.0)).alias("rare_lift")
    )
    scale = float(np.log10(total + ALPHA * (distinct + 1))) if total or distinct else float(np.log10(ALPHA))
    base_score = F.col("counted") + F.coalesce("rare", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)
    return rows.where("kp IS NULL").drop("h", "hp", "kp", "kc").join(rare, "row", "left").select(
        F.col("id").alias(id_col), held_out.alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        base_score.alias("base_score"), (base_score + F.col("lift") + F.coalesce("rare_lift", F.lit(0.0))).alias("score"),
    )
