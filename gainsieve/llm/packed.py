"""Columns of integers packed for a shuffle, and buckets of hashes.

Tasks send sorted columns as one compressed value for each bucket of hashes. Rows that are
equal in a task are sent once, so no bucket grows with how often a value occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, by byte planes, so that sorted and small numbers take little room."""
    planes = b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return zstandard.compress(planes, 1)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes]


def summed(key: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted different keys and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    firsts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[firsts], [np.add.reduceat(v[order], firsts) if len(firsts) else v for v in values]


def bucket_of(hashes: np.ndarray, bits: int, width: int) -> np.ndarray:
    return (hashes >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def runs_of(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    firsts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if len(buckets) else []
    for a, b in zip(firsts, np.append(firsts[1:], len(buckets)).astype(np.int64) if len(buckets) else [], strict=True):
        yield int(buckets[a]), slice(int(a), int(b))
