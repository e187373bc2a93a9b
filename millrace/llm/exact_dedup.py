"""Exact dedup by Patricia-trie owners.

Rows are dealt by length and content hash. Each input partition first inserts its byte
strings into a local compressed radix trie, so that a hot text crosses the shuffle once per
input partition; the owner of each (length, hash) then inserts the full byte strings into
its own trie, whose terminal nodes hold the smallest and largest identifier and the count.
A trie over its memory budget spills whole subtrees to a temporary file and finishes them
one by one. Documents learn their class by an equi-join on (length, SHA-256), which
adaptive execution may split where a class is hot.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import bounded_batches
from millrace.llm.worker import owns


class Node:
    """Children by first byte as (label, node); ``value`` is the terminal's payload or None."""

    __slots__ = ("children", "value")

    def __init__(self, value=None):
        self.children: dict[int, tuple[bytes, Node]] = {}
        self.value = value


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection over slices."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class PatriciaTrie:
    """Compressed radix trie over byte strings whose payloads merge; bounded by spilling subtrees.

    ``merge(old, new)`` combines payloads of equal strings. When the labels exceed ``budget``
    bytes, the branch (the next byte after the ``depth`` bytes that all strings share) with most
    bytes goes to a temporary file; later strings of that branch are appended to it.
    """

    def __init__(self, merge, budget: int = 64 << 20, depth: int = 0, folder: str | None = None):
        self.merge, self.budget, self.depth = merge, budget, depth
        self.roots: dict[bytes, Node] = {}
        self.sizes: dict[bytes, int] = {}
        self.spilled: dict[bytes, tuple] = {}
        self.shared: dict[bytes, bytes] = {}
        self.used = self.terminals = 0
        self._folder = folder

    def insert(self, body: bytes, value) -> None:
        branch = body[self.depth : self.depth + 1]
        if branch in self.spilled:
            self._append(branch, body, value)
            return
        root = self.roots.get(branch)
        if root is None:
            root = self.roots[branch] = Node()
            self.sizes[branch] = 0
        added = self._insert(root, body, value)
        self.sizes[branch] += added
        self.used += added
        while self.used > self.budget and self.terminals > 1:
            self._spill(max(self.sizes, key=self.sizes.get))

    def _insert(self, node: Node, body: bytes, value) -> int:
        at = 0
        while True:
            if at == len(body):
                if node.value is None:
                    node.value = value
                    self.terminals += 1
                    return 100
                node.value = self.merge(node.value, value)
                return 0
            edge = node.children.get(body[at])
            if edge is None:
                node.children[body[at]] = (body[at:], Node(value))
                self.terminals += 1
                return len(body) - at + 300
            label, child = edge
            if body.startswith(label, at):
                at += len(label)
                node = child
                continue
            k = _common(label, body[at : at + len(label)])
            middle = Node()
            middle.children[label[k]] = (label[k:], child)
            node.children[body[at]] = (label[:k], middle)
            node, at = middle, at + k

    def _append(self, branch: bytes, body: bytes, value) -> None:
        pickle.dump((body, value), self.spilled[branch][0], protocol=5)
        self.shared[branch] = self.shared[branch][: _common(self.shared[branch], body)]

    def _spill(self, branch: bytes) -> None:
        if self._folder is None:
            self._folder = tempfile.mkdtemp(prefix="trie-")
        handle, path = tempfile.mkstemp(dir=self._folder)
        self.spilled[branch] = (os.fdopen(handle, "wb"), path)
        for k, (body, value) in enumerate(self._walk(self.roots.pop(branch))):
            if not k:
                self.shared[branch] = body
            self._append(branch, body, value)
            self.terminals -= 1
        self.used -= self.sizes.pop(branch)

    @staticmethod
    def _walk(root: Node) -> Iterator[tuple[bytes, object]]:
        stack = [(b"", root)]
        while stack:
            path, node = stack.pop()
            if node.value is not None:
                yield path, node.value
            for label, child in node.children.values():
                stack.append((path + label, child))

    def items(self) -> Iterator[tuple[bytes, object]]:
        """Every string once with its merged payload; ends the trie and removes its files."""
        try:
            for root in self.roots.values():
                yield from self._walk(root)
            self.roots = {}
            for branch, (handle, path) in self.spilled.items():
                handle.close()
                part = PatriciaTrie(self.merge, self.budget, max(self.depth + 1, len(self.shared[branch])))
                with open(path, "rb") as rows:
                    os.unlink(path)
                    while True:
                        try:
                            part.insert(*pickle.load(rows))
                        except EOFError:
                            break
                yield from part.items()
        finally:
            for handle, path in self.spilled.values():
                handle.close()
                if os.path.exists(path):
                    os.unlink(path)
            if self._folder:
                os.rmdir(self._folder)


def _merge(a, b):
    """(smallest, largest, count) of two payloads; identifiers may be null."""
    lo = a[0] if b[0] is None else b[0] if a[0] is None else min(a[0], b[0])
    hi = a[1] if b[1] is None else b[1] if a[1] is None else max(a[1], b[1])
    return lo, hi, a[2] + b[2]


PART = pa.schema([("n_bytes", pa.int64()), ("content_hash", pa.int64()), ("digest", pa.binary()), ("body", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64())])
PART_DDL = "n_bytes long, content_hash long, digest binary, body binary, lo long, hi long, n long"
OWNER = pa.schema([("n_bytes", pa.int64()), ("digest", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64())])
OWNER_DDL = "n_bytes long, digest binary, lo long, hi long, n long"


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4 << 20, width: int | None = None) -> Iterator[pa.RecordBatch]:
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += 64 + (len(row[width]) if width is not None else 0)
        if held_bytes >= size:
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, held_bytes = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def _local(budget: int):
    """Local combine: a full trie is emitted and begun again, so nothing spills on the map side."""

    def rows(trie: PatriciaTrie) -> Iterator[tuple]:
        for body, (lo, hi, n) in trie.items():
            digest = hashlib.sha256(body).digest()
            yield len(body), int.from_bytes(digest[:8], "big", signed=True), digest, body, lo, hi, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("exact")
        trie = PatriciaTrie(_merge, 1 << 62)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                trie.insert(text, (i, i, 1))
            if trie.used > budget:
                yield from _batches(rows(trie), PART, width=3)
                trie = PatriciaTrie(_merge, 1 << 62)
        yield from _batches(rows(trie), PART, width=3)

    return run


def _owner(budget: int):
    """Owner of (length, hash): equality is decided on full byte strings in the trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("exact")
        trie = PatriciaTrie(_merge, budget)
        for batch in batches:
            for body, lo, hi, n in zip(*(batch.column(c).to_pylist() for c in ("body", "lo", "hi", "n"))):
                trie.insert(body, (lo, hi, n))

        def rows():
            for body, (lo, hi, n) in trie.items():
                yield len(body), hashlib.sha256(body).digest(), lo, hi, n

        yield from _batches(rows(), OWNER)

    return run


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", trie_bytes: int = 48 << 20) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; a null text counts as empty. ``keep`` is
    "max" or "min": which identifier of equal texts stays. Null identifiers never win over
    others; where all of a class are null, keep_id is null and its rows are kept. Rows that
    repeat both identifier and text share their flag. Empty tables give no rows; further
    columns are ignored, whatever their names.
    """
    bounded_batches(df.sparkSession)
    base = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    parts = base.mapInArrow(_local(trie_bytes), PART_DDL).repartition("n_bytes", "content_hash")
    owners = parts.mapInArrow(_owner(trie_bytes), OWNER_DDL)
    keep_id = F.col("hi" if keep == "max" else "lo")
    rows = base.select("id", F.octet_length("body").cast("long").alias("n_bytes"), F.unhex(F.sha2("body", 256)).alias("digest"))
    return rows.join(owners, ["n_bytes", "digest"]).select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
