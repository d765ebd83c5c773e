"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORK_BYTES = 1 << 18  # texts are handled in slices of about this size inside an Arrow batch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; NULL for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def slices(texts: pd.Series, limit: int = WORK_BYTES, lower: bool = False) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as UTF-8, about ``limit`` bytes at a time; null counts as empty.

    Yields the position of the first text of each slice.  A text larger than
    the limit is a slice of its own.
    """
    at, got, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t.lower() if lower else t).encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if got and size + len(b) > limit:
            yield at, got
            at, got, size = i, [], 0
        got.append(b)
        size += len(b)
    if got:
        yield at, got


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a slice, each text followed by one newline, and the start of each text (plus the end)."""
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return data, starts


_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse modulo 2**64, kept for the next call."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_MUL, _INV)):
            row = np.full(n + n // 2, base, dtype=np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run ``data[start:end]``, equal for equal runs wherever they stand."""
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    return mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    low = _LOWER[data]
    start, end = runs(~_SPACE[low])
    return run_hashes(low, start, end), start


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the system at the end of a task or batch.

    Arrow's pool and the allocator keep it otherwise for as long as the worker
    lives, and the workers of earlier stages live on beside those of later ones.
    """
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
