"""Words of a batch of texts as 64-bit numbers, worked out with whole-array operations.

Words are runs of bytes other than `[\\x20\\x09-\\x0D]`. A word's number is a polynomial over a
table of random numbers, one per byte, modulo 2^64, mixed at the end. Two words of one corpus
of ten billion have the same number with a chance of about one in three.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEED = 20240229
BASE = 0x9E3779B97F4A7C15 | 1
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(SEED)
BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_BYTES = BYTES.copy()
LOWER_BYTES[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]
RUN = 1 << 16
POWERS = np.cumprod(np.full(RUN, BASE, np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """All words of a batch: where they lie in `buffer`, their numbers, and the words per text."""

    buffer: bytes
    starts: np.ndarray
    ends: np.ndarray
    numbers: np.ndarray
    firsts: np.ndarray
    """Word index at which each text begins; one entry more at the end."""


def words_of(texts: list[bytes], fold_case: bool) -> Words:
    """The words of these UTF-8 texts; `fold_case` takes A-Z as a-z in the numbers."""
    buffer = b"\n".join([*texts, b""])
    raw = np.frombuffer(buffer, np.uint8)
    border = np.empty(len(raw) + 1, bool)
    border[0] = True
    np.take(IS_SPACE, raw, out=border[1:])
    edges = np.flatnonzero(border[1:] != border[:-1])
    if len(edges) % 2:  # cannot be: every text ends with a space
        raise ValueError("a word has no end")
    starts, ends = edges[0::2], edges[1::2]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    limits = np.concatenate([[0], np.cumsum(sizes)])
    firsts = np.searchsorted(starts, limits)
    return Words(buffer, starts, ends, _numbers(raw, starts, ends, fold_case), firsts)


def _numbers(raw, starts, ends, fold_case: bool) -> np.ndarray:
    """Sum of table[byte] * base^(place from the word's start), by running sums from the end."""
    table = LOWER_BYTES if fold_case else BYTES
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    # short words: place by place over all words that are long enough
    order = np.argsort(lengths, kind="stable") if len(lengths) else lengths
    by_length = lengths[order]
    at = starts[order]
    sums = np.zeros(len(order), np.uint64)
    longest = int(by_length[-1])
    for place in range(min(longest, 48)):
        first = np.searchsorted(by_length, place, side="right")
        sums[first:] += table[raw[at[first:] + place]] * POWERS[place]
    # what is longer than that is rare: one word at a time, in runs
    for i in range(np.searchsorted(by_length, 48, side="right"), len(order)):
        for begin in range(48, int(by_length[i]), RUN):
            stop = min(begin + RUN, int(by_length[i]))
            part = table[raw[at[i] + begin : at[i] + stop]] * POWERS[: stop - begin]
            both = np.array([begin, part.sum(dtype=np.uint64)], np.uint64)
            sums[i : i + 1] += mix(mix(both[:1]) ^ both[1:])
    out[order] = sums
    return mix(out + lengths.astype(np.uint64))
