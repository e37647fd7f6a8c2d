"""Columns of many small numbers as one binary value, so that Spark moves few large rows.

Hashed keys are kept to 48 bits, sorted, and stored as differences; every column
takes the narrowest unsigned type that holds it. A key's bucket is its share of the
key range, so the sorted keys of a bucket lie together.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

KEY_BITS = 48


def short_key(hashes: np.ndarray) -> np.ndarray:
    """48-bit keys of 64-bit hashes."""
    return hashes >> np.uint64(64 - KEY_BITS)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets)) >> np.uint64(32)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers, of one length or not."""
    out = [struct.pack("<B", len(columns))]
    for c in columns:
        most = int(c.max()) if len(c) else 0
        width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
        out += [struct.pack("<BI", width, len(c)), c.astype(f"<u{width}").tobytes()]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The columns as 64-bit integers (unsigned)."""
    at, columns = 1, []
    for _ in range(blob[0]):
        width, n = struct.unpack_from("<BI", blob, at)
        columns.append(np.frombuffer(blob, f"<u{width}", n, at + 5).astype(np.uint64))
        at += 5 + width * n
    return columns


def pack_sorted(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending keys as differences, with further columns."""
    return pack(np.diff(keys, prepend=np.uint64(0)), *columns)


def unpack_sorted(blob: bytes) -> list[np.ndarray]:
    steps, *columns = unpack(blob)
    return [np.cumsum(steps, dtype=np.uint64), *columns]


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, its slice) of ascending keys."""
    if len(keys):
        of = bucket_of(keys, buckets)
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            yield int(of[a]), slice(int(a), int(b))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)
