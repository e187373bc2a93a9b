"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of identifier. File layout (little-endian):

    data blocks   zstd of entries; each entry: shared key bytes (u16), own key bytes (u16),
                  value bytes (u32), own key bytes, value
    Bloom filter  bits, then nothing
    block index   per block: first key (u16 length, bytes), offset (u64), bytes (u32), entries (u32)
    footer        offset and bytes of filter and of index (4 x u64), entries (u64), tokens (u64),
                  hashes (u32), magic "MRSST001"

A key is the identifier as 9 bytes: 1 and the big-endian integer with its sign flipped; a null
identifier is the single byte 0 and sorts first. Repeated identifiers stand side by side. A
value is the ids as little-endian unsigned 32-bit integers, or 16-bit after a byte that says so.
Lookup: footer, filter, binary search of the sparse index, one block.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.files import open_fs, write_atomic
from millrace.llm.wordhash import spans
from millrace.session import bounded_batches, shared_path
from millrace.llm.worker import cache, owns

MAGIC = b"MRSST001"
FOOTER = struct.Struct("<6QI8s")
SUFFIX = ".mrsst"


def key_of(doc: int | None) -> bytes:
    return b"\x00" if doc is None else b"\x01" + ((doc + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def doc_of(key: bytes) -> int | None:
    return None if key == b"\x00" else int.from_bytes(key[1:], "big") - (1 << 63)


def pack(ids: np.ndarray) -> bytes:
    if not len(ids) or int(ids.max()) < 1 << 16:
        return b"\x02" + ids.astype("<u2").tobytes()
    return b"\x04" + ids.astype("<u4").tobytes()


def unpack(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


def _hashes(key: bytes, bits: int, k: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b + i * i * 0x85EBCA6B) % bits for i in range(k)]


def sstable(rows: Iterable[tuple[int | None, bytes]], block_bytes: int = 1 << 16, bits_a_key: int = 10) -> Iterator[bytes | tuple]:
    """The bytes of a shard from rows in order of key; the last item is (entries, tokens)."""
    k, at, tokens = 7, 0, 0
    index: list[tuple[bytes, int, int, int]] = []
    keys: list[bytes] = []
    block, block_size, first, before, n = [], 0, b"", b"", 0

    packer = zstandard.ZstdCompressor(level=1)

    def close() -> bytes:
        nonlocal at
        data = packer.compress(b"".join(block))
        index.append((first, at, len(data), n))
        at += len(data)
        return data

    for doc, value in rows:
        key = key_of(doc)
        if block and block_size >= block_bytes:
            yield close()
            block, block_size, n = [], 0, 0
        if not block:
            first = key
            shared = 0
        else:
            shared = len(os.path.commonprefix([key, before]))
        block += (struct.pack("<HHI", shared, len(key) - shared, len(value)), key[shared:], value)
        block_size += 8 + len(key) - shared + len(value)
        n += 1
        before = key
        keys.append(key)
        tokens += (len(value) - 1) // value[0]
    if block:
        yield close()
    bits = max(64, len(keys) * bits_a_key)
    filled = np.zeros(bits, bool)
    for key in keys:
        filled[_hashes(key, bits, k)] = True
    bloom = np.packbits(filled, bitorder="little").tobytes()
    yield bloom
    table = b"".join(struct.pack("<H", len(f)) + f + struct.pack("<QII", o, s, c) for f, o, s, c in index)
    yield table
    yield FOOTER.pack(at, len(bloom), at + len(bloom), len(table), len(keys), tokens, k, MAGIC)
    yield len(keys), tokens


class SSTable:
    """A shard opened for reading; only footer, filter and index are held."""

    def __init__(self, uri: str):
        self.system, self.path = open_fs(uri)
        size = self.system.get_file_info(self.path).size
        self.file = self.system.open_input_file(self.path)
        raw = self.file.read_at(FOOTER.size, size - FOOTER.size)
        at, n, index_at, index_n, self.entries, self.tokens, self.k, magic = FOOTER.unpack(raw)
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.bloom, table = self.file.read_at(n, at), self.file.read_at(index_n, index_at)
        self.bits = max(64, self.entries * 10)
        self.blocks, pos = [], 0
        while pos < len(table):
            (size,) = struct.unpack_from("<H", table, pos)
            first = table[pos + 2 : pos + 2 + size]
            self.blocks.append((first, *struct.unpack_from("<QII", table, pos + 2 + size)))
            pos += 2 + size + 16

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size, _ = self.blocks[k]
        data, pos, key = zstandard.decompress(self.file.read_at(size, at)), 0, b""
        while pos < len(data):
            shared, own, n = struct.unpack_from("<HHI", data, pos)
            key = key[:shared] + data[pos + 8 : pos + 8 + own]
            yield key, data[pos + 8 + own : pos + 8 + own + n]
            pos += 8 + own + n

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, value in self._block(k):
                yield doc_of(key), unpack(value)

    def get(self, doc: int | None) -> np.ndarray | None:
        """The ids of a document (the first of a repeated identifier), or None."""
        key = key_of(doc)
        if not self.entries or not all(self.bloom[h >> 3] >> (h & 7) & 1 for h in _hashes(key, self.bits, self.k)):
            return None
        # a repeated key may begin in the block before the last one that starts at or below it
        k = max(0, bisect.bisect_left([b[0] for b in self.blocks], key) - 1)
        while k < len(self.blocks) and self.blocks[k][0] <= key:
            for found, value in self._block(k):
                if found == key:
                    return unpack(value)
            k += 1
        return None

    def close(self) -> None:
        self.file.close()


class WordEncoder:
    """Whole texts through a tokenizer that lower-cases and never looks across ASCII white space.

    The tokenizers library encodes each distinct run between spaces; its ids are kept in one pool,
    found by the run's 64-bit hash in a sorted table, and texts are put together from the pool
    by array operations. New runs go through the library together, with a mark of a single id
    between them that none of them holds. At ``most`` runs all are forgotten.

    With ``added``, the file's added tokens are found in the bytes as they came, before lower-casing, and become
    their ids, as the library does by itself; without, their letters are text like any other.
    """

    MARK = "\u2022"
    #: Marks at the end of a run that the tokenizer always takes apart from letters before them.
    ENDS = ".,!?;:|$%&*#)"

    def __init__(self, path: str, most: int = 1_500_000, recent: int = 60_000, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # runs are lower-cased: what looks like an added token there need not be one
        tokens = self.tokenizer.get_added_tokens_decoder() if added else {}
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in tokens.values()):
            raise ValueError(f"{path} has added tokens that aren't matched literally")
        self.added = {t.content.encode(): np.array([i], np.uint32) for i, t in tokens.items()}
        self.added_re = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + b")") if tokens else None
        self.most, self.recent = most, recent
        mark = self._ids(self.MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.ends: dict[str, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        self.table, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, their entries
        self.late: dict[int, int] = {}  # hashes not yet in the table
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.size, self.n = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32), 0

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _library(self, runs: list[str]) -> list[np.ndarray]:
        """Ids of each run, from the library."""
        out = []
        for k in range(0, len(runs), 1024):
            some = runs[k : k + 1024]
            text = " ".join(some)
            if self.mark is not None and self.MARK not in text:
                ids = np.array(self._ids(f" {self.MARK} ".join(some)), np.uint32)
                cuts = np.flatnonzero(ids == self.mark)
                if len(cuts) == len(some) - 1:
                    ends = [*cuts.tolist(), len(ids)]
                    starts = [0, *(c + 1 for c in ends[:-1])]
                    out += [ids[a:b] for a, b in zip(starts, ends)]
                    continue
            out += [np.array(self._ids(run), np.uint32) for run in some]
        return out

    def _learn(self, hashes: list[int], runs: list[bytes]) -> None:
        asked, ends = [], []
        for run in runs:
            text = run.decode()
            word = text.rstrip(self.ENDS)
            apart = len(word) < len(text) and word and word[-1].isalpha() and word[-1] == word[-1].lower() < "\u0250"
            asked.append(word if apart else text)
            ends.append(text[len(word) :] if apart else "")
        new = sorted({e for e in ends if e} - self.ends.keys())
        if len(self.ends) > 10_000:
            self.ends, new = {}, sorted({e for e in ends if e})
        self.ends.update(zip(new, self._library(new)))
        found = [np.concatenate([a, self.ends[e]]) if e else a for a, e in zip(self._library(asked), ends)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total = int(sizes.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        while self.n + len(found) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros(len(x), x.dtype)]) for x in (self.start, self.size))
        self.pool[self.used : self.used + total] = np.concatenate(found) if found else 0
        self.start[self.n : self.n + len(found)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(found)] = sizes
        self.late.update(zip(hashes, range(self.n, self.n + len(found))))
        self.used += total
        self.n += len(found)

    def _find(self, own: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where it is unknown."""
        out = np.full(len(own), -1)
        if len(self.table):
            at = np.minimum(np.searchsorted(self.table, own), len(self.table) - 1)
            hit = self.table[at] == own
            out[hit] = self.entry[at[hit]]
        if self.late:
            rest = np.flatnonzero(out < 0)
            out[rest] = [self.late.get(h, -1) for h in own[rest].tolist()]
        return out

    def _some(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if self.n > self.most:
            self._forget()
        data, start, end, hashes, doc = spans(texts)
        own, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        entry = self._find(own)
        new = np.flatnonzero(entry < 0)
        if len(new):
            raw = data.tobytes()
            self._learn(own[new].tolist(), [raw[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])
            entry[new] = np.arange(self.n - len(new), self.n)
            if len(self.late) > self.recent:
                late = np.fromiter(self.late, np.uint64, len(self.late))
                table, at = np.concatenate([self.table, late]), np.concatenate([self.entry, np.fromiter(self.late.values(), np.int64, len(self.late))])
                order = np.argsort(table, kind="stable")
                self.table, self.entry, self.late = table[order], at[order], {}
        of = entry[back]
        sizes = self.size[of].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.start[of] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=sizes, minlength=len(texts)))]).astype(np.int64).tolist()
        yield from (ids[a:b] for a, b in zip(cuts, cuts[1:]))

    def encode_all(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """For each text in UTF-8 its ids."""
        if self.added_re is None:
            yield from self._encode_all(texts)
            return
        cut: deque[list[bytes]] = deque()  # per text begun, its pieces and, between them, its added tokens

        def pieces() -> Iterator[bytes]:
            for text in texts:
                cut.append(self.added_re.split(text))
                yield from cut[-1][::2]

        found = self._encode_all(pieces())
        for ids in found:
            parts = cut.popleft()
            if len(parts) > 1:
                ids = np.concatenate([ids, *(x for t in parts[1::2] for x in (self.added[t], next(found)))])
            yield ids

    def _encode_all(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= 1 << 20:
                yield from self._some(held)
                held, size = [], 0
        if held:
            yield from self._some(held)

    def encode(self, text: bytes) -> np.ndarray:
        return next(self.encode_all([text]))


_ENCODERS: dict[tuple[str, bool], WordEncoder] = cache()


def encoder_of(path: str, added: bool = False) -> WordEncoder:
    """One encoder per Python worker, kept between tasks (a closure would carry its own empty cache)."""
    if (path, added) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, added] = WordEncoder(path, added=added)
    return _ENCODERS[path, added]


WRITTEN = pa.schema([("path", pa.string()), ("first", pa.int64()), ("empty_key", pa.bool_()), ("docs", pa.int64()), ("tokens", pa.int64())])


def write_shards(df: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, partitions: int | None = None, added: bool = False) -> DataFrame:
    """Encode every text, append ``end_id``, write shards to ``folder``; returns one row per shard, in key order: path, docs, tokens, start.

    Documents are dealt by ranges of identifier and sorted, so that the order of shards is the
    order of identifiers. Null texts count as empty (only the end id), null identifiers come
    first, repeated identifiers keep one entry each (in order of text), further columns are
    ignored and an empty table gives no shards. ``added``: see WordEncoder. A task that runs again replaces its file whole.
    """
    bounded_batches(df.sparkSession)
    base = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = base.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("shards")
        encoder, end = encoder_of(tokenizer, added), np.uint32(end_id)
        seen: list = []

        def rows():
            for batch in batches:
                docs = batch.column(0).to_pylist()
                for doc, ids in zip(docs, encoder.encode_all(batch.column(1).cast(pa.binary()).to_pylist())):
                    if not seen:
                        seen.append(doc)
                    yield doc, pack(np.append(ids, end))

        totals: list = []

        def parts():
            for part in sstable(rows()):
                if isinstance(part, tuple):
                    totals.extend(part)
                else:
                    yield part

        context = TaskContext.get()
        ahead = parts()
        head = next(ahead)
        if not seen:
            return

        def whole():
            yield head
            yield from ahead

        path = write_atomic(folder, f"part-{context.partitionId():010d}{SUFFIX}", str(context.taskAttemptId()), whole())
        yield pa.record_batch([pa.array([path]), pa.array([seen[0]], pa.int64()), pa.array([seen[0] is None]), pa.array([totals[0]], pa.int64()), pa.array([totals[1]], pa.int64())], schema=WRITTEN)

    return dealt.mapInArrow(run, "path string, first long, empty_key boolean, docs long, tokens long")


def read_shards(written: DataFrame) -> DataFrame:
    """Rows of written shards, from the files: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit).

    ``written`` has a row per shard (path, tokens); starts are running sums over that small table.
    """
    from pyspark.sql import Window

    starts = written.withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("shards")
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = SSTable(path)
                held, size = [], 0
                for doc, ids in table.scan():
                    held.append((doc, start, len(ids), ids.tobytes()))
                    start += len(ids)
                    size += 4 * len(ids) + 64
                    if size > 4 << 20:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                table.close()

    n = int(written.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return starts.select("path", "base").repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def lookup(paths: list[tuple[str, int | None]], doc: int | None) -> np.ndarray | None:
    """Ids of one document, given the shards as (path, first identifier) in key order."""
    keys = [key_of(first) for _, first in paths]
    k = max(0, bisect.bisect_left(keys, key_of(doc)) - 1)
    for path, first in paths[k:]:
        if key_of(first) > key_of(doc):
            return None
        table = SSTable(path)
        found = table.get(doc)
        table.close()
        if found is not None:
            return found
    return None


def token_files(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, folder: str | None = None, added: bool = False) -> DataFrame:
    """Write the shards, then read them back; see write_shards and read_shards."""
    from millrace.session import materialise

    written = materialise(write_shards(df, tokenizer, folder or shared_path(df.sparkSession, "tokens"), id_col, text_col, end_id, added=added), "shards")
    return read_shards(written)
