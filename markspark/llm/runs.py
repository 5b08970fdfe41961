"""Sorted arrays of 64-bit numbers with counts, as they travel between tasks."""

from __future__ import annotations

import numpy as np
import zstandard


def group_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if not len(keys):
        return keys.astype(np.uint64), counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending keys and columns of equal length, as bytes. Differences of neighbours are small,
    so most of their upper bytes are zero; bytes of one place lie together."""
    steps = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    planes = [steps.view(np.uint8).reshape(-1, 8).T.tobytes()]
    for column in columns:
        planes.append(column.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(content: bytes, columns: int = 1) -> list[np.ndarray]:
    """Keys and columns that `pack` took."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(content), np.uint8)
    parts = raw.reshape(1 + columns, 8, -1).transpose(0, 2, 1)
    keys = np.cumsum(np.ascontiguousarray(parts[0]).view("<u8").ravel(), dtype=np.uint64)
    return [keys, *(np.ascontiguousarray(p).view("<i8").ravel() for p in parts[1:])]


class Counts:
    """Counts of keys in one task, merged whenever they outgrow `limit` entries."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        """True when it is time to `take`."""
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > 2 * self.limit:
            merged, sums = group_sums(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.size = [merged], [sums], len(merged)
        return self.size > self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([*self.keys, np.empty(0, np.uint64)])
        counts = np.concatenate([*self.counts, np.empty(0, np.int64)])
        self.keys, self.counts, self.size = [], [], 0
        return group_sums(keys, counts)
