"""Words of many texts at once: 64-bit hashes without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from millrace.llm.worker import cache

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        step = min(size, n - size)
        out[size : size + step] = out[:step] * np.uint64(pow(base, size, 1 << 64))
        size += step
    return out


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = cache()


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    for size, found in _CACHE.items():
        if size >= n:
            return found
    _CACHE.clear()
    n = 1 << max(20, (n - 1).bit_length())
    _CACHE[n] = _powers(_BASE, n), _powers(_INVERSE, n)
    return _CACHE[n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
END = np.uint64(0)  # the end of a text; a word never has this hash


def slabs(texts: list[bytes | None], most: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of some bytes each; one longer text stands alone."""
    held, size, first = [], 0, 0
    for k, text in enumerate(texts):
        held.append(text or b"")
        size += len(held[-1])
        if size > most:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one array of bytes, A-Z lower-cased, and start, end, hash and text number of each word."""
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(0, np.uint64), none
    edge = np.diff(np.concatenate([[1], _SPACE[data].view(np.int8), [1]]))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    hashes[hashes == END] = 1
    first = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return data, start, end, hashes, np.searchsorted(first, start, side="right") - 1


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and hash of the last four bytes of each word, A-Z lower-cased, split at ASCII white space."""
    data, start, end, hashes, doc = spans(texts)
    tail = np.zeros(len(start), np.uint64)
    for back in range(1, 5):
        at = end - back
        tail = (tail << np.uint64(8)) | np.where(at >= start, data[np.maximum(at, 0)], 0).astype(np.uint64)
    return hashes, doc, mix(tail + np.uint64(1))
