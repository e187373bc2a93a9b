"""Numeric kernels that need half precision or wrapping 64-bit arithmetic: numpy, applied through pandas UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

BLOCK = 32


def _blocks(x: np.ndarray) -> np.ndarray:
    if x.shape[-1] % BLOCK:
        raise ValueError(f"the last dimension must be a multiple of {BLOCK}")
    return x.astype(np.float32).reshape(*x.shape[:-1], -1, BLOCK)


def _inverse(d: np.ndarray) -> np.ndarray:
    return np.where(d != 0, 1 / np.where(d != 0, d, 1), 0).astype(np.float32)


def q4_0(x: np.ndarray) -> np.ndarray:
    """Quantise and dequantise blocks of 32 to 4 bits; the first largest magnitude sets the step, kept in half precision."""
    b = _blocks(x)
    at = np.abs(b).argmax(-1, keepdims=True)
    d = np.take_along_axis(b, at, -1) / np.float32(-8)
    q = np.clip(np.floor(b * _inverse(d) + np.float32(8.5)), 0, 15)
    return ((q - 8) * d.astype(np.float16).astype(np.float32)).reshape(x.shape)


def q8_0(x: np.ndarray) -> np.ndarray:
    """Quantise and dequantise blocks of 32 to 8 bits, halves to even."""
    b = _blocks(x)
    d = np.abs(b).max(-1, keepdims=True) / np.float32(127)
    q = np.clip(np.rint(b * _inverse(d)), -128, 127)
    return (q * d.astype(np.float16).astype(np.float32)).reshape(x.shape)


def splitmix64(x):
    """The published splitmix64 step on a number or an array of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        z = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def vector_udf(kernel):
    """A kernel over vectors as a column: those of one length go through it as one array."""

    @F.pandas_udf("array<float>")
    def run(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), index=v.index, dtype=object)
        sizes = v.map(lambda a: -1 if a is None else len(a))
        for n, at in sizes.groupby(sizes).groups.items():
            if n >= 0:
                out.loc[at] = list(kernel(np.stack(v.loc[at].to_numpy()).astype(np.float32)))
        return out

    return run


def _seeds(seed: pd.Series, position: pd.Series) -> pd.Series:
    mixed = splitmix64(seed.to_numpy(np.int64).view(np.uint64) ^ splitmix64(position.to_numpy(np.int64).view(np.uint64)))
    return pd.Series((mixed & np.uint64((1 << 63) - 1)).astype(np.int64))


def stream_seed(seed, position):
    """A seed of 63 bits for a position of a stream, as a column."""
    return F.pandas_udf(_seeds, "long")(seed, position)
