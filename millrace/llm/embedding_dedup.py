"""Embedding near-dedup with randomised-rotation binary codes.

Equal vectors become one class. A unit vector, padded with zeros and turned by a fixed random
rotation, is stored as the signs of its D coordinates and the factor f = <signs / sqrt(D),
vector>. For another vector q, <signs / sqrt(D), q> / f is an unbiased estimate of the cosine
whose error is within sqrt(1 - f^2) / f * eps / sqrt(D - 1) but for a vanishing chance; q is read
as 4-bit numbers, so the inner product is a sum of bit counts. Only pairs that the bound
can't rule out are recomputed in double precision from the vectors themselves.

Candidates share the signs of a band of further random rotations. The number of bands is
such that a pair at the threshold misses all with a chance of one in a million. Groups
larger than a block are compared block by block; counts, not pairs, come out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.graph import components
from millrace.session import bounded_batches, materialise
from millrace.llm.worker import owns

EPS = 5.5
PLANES = 4


@lru_cache(4)
def _rotation(dim: int, seed: int, out: int) -> np.ndarray:
    """``out`` x ``dim`` with orthonormal columns (out >= dim)."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, out]).standard_normal((out, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(2)
def _hyperplanes(dim: int, seed: int, n: int) -> np.ndarray:
    return np.concatenate([_rotation(dim, seed + 1 + k, dim) for k in range(-(-n // dim))])[:n]


def code_bits(dim: int) -> int:
    return -(-2 * dim // 64) * 64


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def encode(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows of 64-bit words) and correction factors of unit vectors."""
    turned = unit @ _rotation(unit.shape[1], seed, code_bits(unit.shape[1])).T
    return _pack(turned > 0), np.abs(turned).sum(1) / math.sqrt(turned.shape[1])


def quantised(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query side: bit planes, and offset, step and sum of the 4-bit numbers; at most half a step off a coordinate."""
    turned = unit @ _rotation(unit.shape[1], seed, code_bits(unit.shape[1])).T
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / (2**PLANES - 1), 1e-12)
    number = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, 2**PLANES - 1).astype(np.uint8)
    return np.stack([_pack((number >> k) & 1) for k in range(PLANES)]), low, step, number.sum(1, dtype=np.int64)


def upper_bound(code: np.ndarray, factor: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Upper confidence bound of the cosine; arguments broadcast (codes against queries), words last."""
    bits = code.shape[-1] * 64
    ones = sum((1 << k) * np.bitwise_count(code & planes[k]).sum(-1, dtype=np.int64) for k in range(PLANES))
    set_ = np.bitwise_count(code).sum(-1, dtype=np.int64)
    # sum over coordinates of (+-1) * (low + step * number)
    inner = (low * (2 * set_ - bits) + step * (2 * ones - total)) / math.sqrt(bits)
    slack = np.sqrt(np.maximum(0.0, 1 - factor**2)) * EPS / math.sqrt(bits - 1) + step * EPS / math.sqrt(12)
    return (inner + slack) / factor


def plan_bands(n: int, threshold: float, miss: float = 1e-6) -> tuple[int, int]:
    """(bits of a band, bands) for ``n`` vectors: bits grow with log n, so random company in a bucket stays rare."""
    bits = min(44, max(8, math.ceil(math.log2(max(2, n))) + 4))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def _bands(unit: np.ndarray, seed: int, bits: int, bands: int) -> np.ndarray:
    signs = (unit @ _hyperplanes(unit.shape[1], seed, bits * bands).T > 0).reshape(len(unit), bands, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def _vectors(values: list) -> list[np.ndarray | None]:
    """Vectors in double precision; None for null, empty, zero and non-finite ones and for those with nulls."""
    out = []
    for v in values:
        a = None if v is None or not len(v) or None in v else np.array(v, float) + 0.0
        out.append(a if a is not None and np.isfinite(a).all() and 0 < np.linalg.norm(a) < np.inf else None)
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, embedding) -> (id, key, vector): key and vector are null where the vector links with nothing."""
    owns("vectors")
    for batch in batches:
        found = _vectors(batch.column(1).to_pylist())
        data = [None if v is None else v.tobytes() for v in found]
        keys = [None if d is None else xxhash.xxh3_128_digest(d) for d in data]
        yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["id", "key", "vector"])


def _by_dim(data: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) for each length of vector."""
    sizes = np.array([len(d) for d in data])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        vectors = np.frombuffer(b"".join(data[k] for k in at.tolist()), float).reshape(len(at), -1)
        yield at, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _members(seed: int, bits: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("vectors")
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data = batch.column(1).to_pylist()
            for k in range(0, len(data), 1024):
                for at, unit in _by_dim(data[k : k + 1024]):
                    keys = _bands(unit, seed, bits, bands)
                    # key, length and band in one number; the band in the low 12 bits
                    bucket = ((keys * 0x1000193 + unit.shape[1]) << 12) | np.arange(bands)
                    yield pa.record_batch([pa.array(bucket.ravel()), pa.array(np.repeat(ids[k + at], bands))], names=["bucket", "id"])

    return run


def _codes(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("vectors")
        for batch in batches:
            data = batch.column("vector").to_pylist()
            codes: list = [None] * len(data)
            factors = np.zeros(len(data))
            for at, unit in _by_dim(data):
                words, f = encode(unit, seed)
                factors[at] = f
                for k, w in zip(at.tolist(), words):
                    codes[k] = w.tobytes()
            yield pa.record_batch([*batch.columns, pa.array(codes, pa.binary()), pa.array(factors)], names=[*batch.schema.names, "code", "factor"])

    return run


OUT = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("b", pa.int64())])


def _compare(threshold: float, seed: int, bits: int, bands: int):
    """Rows in order of (bucket, i, j): per identifier the copies linked (b null), and joining links (links null)."""

    def pairs(group: list[tuple], totals: dict[int, int]) -> Iterator[tuple[int, int]]:
        ids, many, side = (np.array([r[k] for r in group], np.int64) for k in (0, 1, 5))
        band = group[0][6] & 4095
        vectors = np.frombuffer(b"".join(r[2] for r in group), float).reshape(len(group), -1)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(ids)), np.arange(len(ids)))
        if not len(left) or not len(right):
            return
        code = np.frombuffer(b"".join(group[k][3] for k in left.tolist()), np.uint64).reshape(len(left), -1)
        factor = np.array([group[k][4] for k in left.tolist()])
        planes, low, step, total = quantised(unit[right], seed)
        open_ = upper_bound(code[:, None], factor[:, None], planes[:, None], low, step, total) >= threshold
        open_ &= (ids[left][:, None] < ids[right]) if not side.any() else (ids[left][:, None] != ids[right])
        x, y = np.nonzero(open_)
        if not len(x):
            return
        x, y = left[x], right[y]
        if len(x) > 4 * len(ids):
            exact = np.einsum("ij,ij->i", unit[x], unit[y]) if len(x) < 0.05 * len(left) * len(right) else (unit @ unit.T)[x, y]
        else:
            exact = np.einsum("ij,ij->i", unit[x], unit[y])
        hit = exact >= threshold
        x, y = x[hit], y[hit]
        if band and len(x):
            used = np.unique(np.concatenate([x, y]))
            place = np.zeros(len(ids), np.int64)
            place[used] = np.arange(len(used))
            keys = _bands(unit[used], seed, bits, bands)[:, :band]
            fresh = np.concatenate([~(keys[place[x[k : k + 65536]]] == keys[place[y[k : k + 65536]]]).any(1) for k in range(0, len(x), 65536)])
            x, y = x[fresh], y[fresh]
        for a, b in ((x, y), (y, x)):
            own, at = np.unique(a, return_inverse=True)
            for i, n in zip(ids[own].tolist(), np.bincount(at, weights=many[b]).astype(np.int64).tolist()):
                totals[i] = totals.get(i, 0) + n
        root = np.arange(len(ids))
        while len(x):
            differ = root[x] != root[y]
            x, y = x[differ], y[differ]
            if not len(x):
                return
            # one link for each root that can still be joined, then drop what that has joined
            _, first = np.unique(root[x], return_index=True)
            for a, b in zip(x[first].tolist(), y[first].tolist()):
                if root[a] != root[b]:
                    root[root == root[b]] = root[a]
                    yield int(ids[a]), int(ids[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("vectors")
        current, held, totals, links = None, [], {}, []

        def out() -> pa.RecordBatch:
            rows = [(i, n, None) for i, n in totals.items()] + [(a, None, b) for a, b in links]
            totals.clear()
            links.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)

        for batch in batches:
            for bucket, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "id", "many", "vector", "code", "factor", "side"))):
                if (bucket, i, j) != current:
                    if len(held) > 1:
                        links += pairs(held, totals)
                        if len(totals) + len(links) > 200_000:
                            yield out()
                    current, held = (bucket, i, j), []
                held.append((*row, bucket))
        if len(held) > 1:
            links += pairs(held, totals)
        if totals or links:
            yield out()

    return run


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, block: int = 512, seed: int = 7) -> DataFrame:
    """One row per input row: ``id_col``, n_links, component_id, kept.

    Vectors link when their cosine in double precision is at least ``threshold``; vectors of
    different length never do. Null, empty and zero vectors and those with null or non-finite
    components link with nothing. n_links counts the other rows linked directly. Rows are
    told apart by vector, not by identifier: rows that repeat an identifier with different vectors have
    links and components of their own, and rows of null identifier link like any other. component_id is the
    smallest identifier reachable (null where none is known), and every row that bears it is kept. An empty
    table gives no rows; further columns are ignored.
    """
    bounded_batches(df.sparkSession)
    rows = materialise(df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(_keys, "id long, key binary, vector binary"), "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("many"), F.first("vector").alias("vector"))
    classes = classes.mapInArrow(_codes(seed), "key binary, least long, many long, vector binary, code binary, factor double")
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "codes")  # numbers are as written
    known = classes.drop("key", "least")
    bits, bands = plan_bands(known.count(), threshold)
    member = materialise(known.select("id", "vector").mapInArrow(_members(seed, bits, bands), "bucket long, id long"), "buckets")
    sizes = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = member.join(sizes, "bucket").withColumn("parts", F.ceil(F.col("size") / F.lit(block)).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"), (F.col("own") > k).cast("int").alias("side")))
    full = shared.withColumn("own", own).join(known, "id")
    dealt = full.withColumn("cell", F.explode(cells)).select("bucket", "cell.i", "cell.j", "cell.side", "id", "many", "vector", "code", "factor")
    found = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_compare(threshold, seed, bits, bands), "id long, links long, b long")
    found = materialise(found, "embedding-links")
    counts = found.where("b IS NULL").groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.where("b IS NOT NULL").select(F.col("id").alias("a"), "b"), "embedding-components")
    of_class = (
        classes.select("key", "id", "many", "least")
        .join(counts, "id", "left")
        .join(parts, "id", "left")
        .select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
    of_class = materialise(of_class, "embedding-classes")
    heads = of_class.groupBy("component").agg(F.min("least").alias("head"))
    found = of_class.join(heads, "component").select("key", "n_links", "head")
    component = F.when(F.col("key").isNotNull(), F.col("head")).otherwise(F.col("id"))
    return rows.select("id", "key").join(found, "key", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
