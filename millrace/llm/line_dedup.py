"""Line dedup with two Bloom filters.

Line hashes are dealt by segment of the hash space. Each segment streams through a once-seen
and a twice-seen filter: a hash whose bits are all set in the first sets its bits in the
second. A line shared by two documents always reaches the second filter; only documents' lines
found there (repeats and false positives) are shuffled, with their full keys, for the exact
count of documents and the choice of the document that keeps the line. The filters have a
fixed greatest size: beyond it more lines are suspected and shuffled, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.files import list_files, open_fs
from millrace.llm.skew import lookup_join
from millrace.session import bounded_batches, materialise, shared_path
from millrace.llm.worker import cache, owns

SEGMENTS = 256
HASHES = 4
SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, least: int) -> bytes | None:
    """The key of a line, or None where it has fewer than ``least`` code points."""
    key = line.strip(SPACE)
    if len(key) < least or (len(key) < 4 * least and not key.isascii() and len(key.decode()) < least):
        return None
    return key.lower()


def _document_keys(text: bytes, least: int) -> set[bytes]:
    return {k for line in text.split(b"\n") if len(line) >= least and (k := line_key(line, least)) is not None}


def _positions(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit numbers within a segment; ``bits`` is a power of two."""
    a, b = hashes >> np.uint64(8), (hashes >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(bits - 1)).astype(np.int64) for i in range(HASHES)]


def _collect(least: int, flush: int = 1 << 18):
    """Distinct line hashes of a partition by segment; ``again`` holds those that several documents of a flush have."""
    schema = pa.schema([("segment", pa.int32()), ("seen", pa.binary()), ("again", pa.binary())])

    def out(hashes: list[int]) -> pa.RecordBatch:
        values, counts = np.unique(np.array(hashes, np.uint64), return_counts=True)
        twice = values[counts > 1]
        rows = []
        order, order2 = np.argsort(values % np.uint64(SEGMENTS), kind="stable"), np.argsort(twice % np.uint64(SEGMENTS), kind="stable")
        values, twice = values[order], twice[order2]
        cuts = np.searchsorted(values % np.uint64(SEGMENTS), np.arange(SEGMENTS + 1, dtype=np.uint64))
        cuts2 = np.searchsorted(twice % np.uint64(SEGMENTS), np.arange(SEGMENTS + 1, dtype=np.uint64))
        for s in range(SEGMENTS):
            if cuts[s] < cuts[s + 1]:
                rows.append((s, values[cuts[s] : cuts[s + 1]].tobytes(), twice[cuts2[s] : cuts2[s + 1]].tobytes()))
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("lines")
        held: list[int] = []
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                held += map(xxhash.xxh3_64_intdigest, _document_keys(text, least))
                if len(held) > flush:
                    yield out(held)
                    held = []
        if held:
            yield out(held)

    return run


def _filters(bits: int):
    """Per segment, in order: the twice-seen filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("lines")
        current, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([current], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], names=["segment", "filter"])

        for batch in batches:
            for segment, seen, again in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if segment != current:
                    if current is not None and twice.any():
                        yield done()
                    current, once, twice = segment, np.zeros(bits, bool), np.zeros(bits, bool)
                at = _positions(np.frombuffer(seen, np.uint64), bits)
                known = np.logical_and.reduce([once[p] for p in at])
                for p in at:
                    twice[p[known]] = True
                    once[p] = True
                for p in _positions(np.frombuffer(again, np.uint64), bits):
                    twice[p] = True
        if current is not None and twice.any():
            yield done()

    return run


_LOADED: dict[str, np.ndarray] = cache()


def _load(uri: str, bits: int) -> np.ndarray:
    """The twice-seen filters of all segments as one array of bytes, kept per Python worker."""
    if uri not in _LOADED:
        table = np.zeros(SEGMENTS * bits // 8, np.uint8)
        for path, _ in list_files(uri, ".parquet"):
            system, name = open_fs(path)
            with system.open_input_file(name) as f:
                for row in pq.ParquetFile(f).read(["segment", "filter"]).to_pylist():
                    table[row["segment"] * bits // 8 : (row["segment"] + 1) * bits // 8] = np.frombuffer(row["filter"], np.uint8)
        _LOADED.clear()
        _LOADED[uri] = table
    return _LOADED[uri]


def _suspects(least: int, uri: str, bits: int):
    schema = pa.schema([("id", pa.int64()), ("line", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("lines")
        table = _load(uri, bits)
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                own = _document_keys(text, least)
                keys += own
                ids += [doc] * len(own)
            if not keys:
                continue
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            base = (hashes % np.uint64(SEGMENTS)).astype(np.int64) * bits
            hit = np.ones(len(keys), bool)
            for p in _positions(hashes, bits):
                p = p + base
                hit &= (table[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            where = np.flatnonzero(hit).tolist()
            if where:
                yield pa.record_batch([pa.array([ids[k] for k in where], pa.int64()), pa.array([keys[k] for k in where], pa.binary())], schema=schema)

    return run


def _rewrite(least: int, columns: list[str], text_col: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("lines")
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            drops = batch.column("__mr_drops").to_pylist()
            for text, drop in zip(batch.column(text_col).cast(pa.binary()).to_pylist(), drops):
                n = (text or b"").count(b"\n") + 1
                gone = 0
                if drop:
                    drop = set(drop)
                    lines = text.split(b"\n")
                    kept = [x for x in lines if (k := line_key(x, least)) is None or xxhash.xxh3_128_digest(k) not in drop]
                    gone = len(lines) - len(kept)
                    text = b"\n".join(kept)
                texts.append(text)
                n_lines.append(n)
                n_dropped.append(gone)
            made = {text_col: pa.array(texts, pa.binary()).cast(pa.string()), "__mr_lines": pa.array(n_lines, pa.int64()), "__mr_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.record_batch([made[c] if c in made else batch.column(c) for c in schema.names], names=schema.names)

    return run


def line_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, max_filter_bytes: int = 32 << 20, counts: bool = True
) -> DataFrame:
    """The input's rows with repeated lines removed from ``text_col``; with ``counts`` also n_lines (before) and n_dropped.

    Keys of at least ``least_chars`` code points in at least ``least_docs`` documents lose their
    lines everywhere but in the document of largest identifier that holds them. A null text is
    one empty line and stays null; an empty text stays. Each row counts as a document; rows that
    repeat an identifier share what is dropped; a null identifier comes below all others and, where
    a key is held by null identifiers only, they keep it. Other columns pass unchanged, except
    that existing columns n_lines and n_dropped are replaced where ``counts`` is set. An empty
    table gives no rows.
    """
    bounded_batches(df.sparkSession)
    spark = df.sparkSession
    base = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    n_bytes = base.agg(F.coalesce(F.sum(F.octet_length("body").cast("long")), F.lit(0))).first()[0]
    # a key has at least least_chars bytes and a line end: that bounds the keys; two bits for each, within the greatest size
    wanted = max(1 << 10, min(2 * n_bytes // (least_chars + 1), 8 * max_filter_bytes) // SEGMENTS)
    bits = 1 << (wanted.bit_length() - (wanted & (wanted - 1) == 0))
    bits = min(bits, 8 * max_filter_bytes // SEGMENTS)
    uri = shared_path(spark, "line-filters")
    hashes = base.select("body").mapInArrow(_collect(least_chars), "segment int, seen binary, again binary")
    hashes.repartition("segment").sortWithinPartitions("segment").mapInArrow(_filters(bits), "segment int, filter binary").write.parquet(uri)
    suspects = materialise(base.mapInArrow(_suspects(least_chars, uri, bits), "id long, line binary"), "line-suspects")
    owners = materialise(suspects.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("owner")).where(F.col("n") >= least_docs), "line-owners")
    total = owners.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lost = lookup_join(suspects, owners, "line", "n", total).where(~F.col("id").eqNullSafe(F.col("owner"))).select("id", "line")
    digests = lost.mapInArrow(_digest, "id long, digest binary")
    drops = digests.groupBy("id").agg(F.collect_set("digest").alias("__mr_drops")).withColumnRenamed("id", "__mr_id")
    joined = df.join(drops, F.col(id_col).cast("long").eqNullSafe(F.col("__mr_id")), "left").drop("__mr_id")
    columns = [c for c in df.columns]
    fields = [f for f in df.schema.fields]
    ddl = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in fields) + ", `__mr_lines` long, `__mr_dropped` long"
    names = pa.schema([(c, pa.null()) for c in columns + ["__mr_lines", "__mr_dropped"]])
    out = joined.mapInArrow(_rewrite(least_chars, columns, text_col, names), ddl)
    kept = [F.col(f"`{c}`") for c in columns if not (counts and c in ("n_lines", "n_dropped"))]
    return out.select(*kept, *([F.col("__mr_lines").alias("n_lines"), F.col("__mr_dropped").alias("n_dropped")] if counts else []))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    owns("lines")
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array(list(map(xxhash.xxh3_128_digest, batch.column(1).to_pylist())), pa.binary())], names=["id", "digest"])
