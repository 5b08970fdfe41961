"""Counts of a batch's n-grams in an open-addressed table of NumPy arrays.

A batch is one buffer of terms with single blanks between them, so that every n-gram is a range of
its bytes. All n-grams of the batch are hashed at once (xxHash64, by classes of equal length) and
looked up at once: each one that is still without a slot looks at its next slot, claims it if it is
free, and stays if the slot's n-gram has the same hash and the same bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

from markspark.llm.terms import term_pieces

BATCH_BYTES = 1 << 19
LONG = 256
"""Longer n-grams are rare: they are hashed and compared one by one."""
# the five primes of xxHash64, fixed values
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (
        0x9E3779B185EBCA87,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5,
    )
)
# what CRC-32 does to one byte; from the checksum of that byte alone
_CRC = np.array(
    [zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFFFFFFFF ^ 0x00FFFFFF for b in range(256)], np.uint32
)


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed_in(lane: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _rotated(lane + word * _P2, 31) * _P1


class Bytes:
    """A buffer from which whole words can be read at any places."""

    def __init__(self, content: bytes) -> None:
        self.content = content
        padded = content + bytes(8)
        self.raw = np.frombuffer(padded, np.uint8)
        n = len(content) + 1
        self.eights = np.ndarray((n,), "<u8", padded, strides=(1,))
        self.fours = np.ndarray((n,), "<u4", padded, strides=(1,))

    def hashes(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """xxHash64 of all these ranges."""
        return self._by_length(starts, lengths, self._hashes_of, xxhash.xxh64_intdigest)

    def checksums(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """CRC-32 of all these ranges."""
        return self._by_length(starts, lengths, self._checksums_of, zlib.crc32)

    def _by_length(self, starts, lengths, many, one) -> np.ndarray:
        """`many` ranges of one length at a time; `one` for each long range."""
        out = np.empty(len(starts), np.uint64)
        short = np.minimum(lengths, LONG + 1).astype(np.uint16)
        order = np.argsort(short, kind="stable")
        sizes, first = np.unique(short[order], return_index=True)
        for size, a, b in zip(sizes.tolist(), first, [*first[1:], len(order)]):
            rows = order[a:b]
            if size <= LONG:
                out[rows] = many(starts[rows], size)
            else:
                out[rows] = [
                    one(self.content[s : s + n])
                    for s, n in zip(starts[rows].tolist(), lengths[rows].tolist())
                ]
        return out

    def _checksums_of(self, at: np.ndarray, size: int) -> np.ndarray:
        crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for place in range(size):
            crc = _CRC[(crc & 0xFF) ^ self.raw[at + place]] ^ (crc >> np.uint32(8))
        return ~crc

    def _hashes_of(self, at: np.ndarray, size: int) -> np.ndarray:
        place = 0
        if size >= 32:
            zero = np.zeros(len(at), np.uint64)
            lanes = [zero + _P1 + _P2, zero + _P2, zero, zero - _P1]
            while size - place >= 32:
                for i in range(4):
                    lanes[i] = _mixed_in(lanes[i], self.eights[at + (place + 8 * i)])
                place += 32
            h = sum(_rotated(v, bits) for v, bits in zip(lanes, (1, 7, 12, 18)))
            for lane in lanes:
                h = (h ^ _mixed_in(zero, lane)) * _P1 + _P4
        else:
            h = np.full(len(at), _P5)
        h = h + np.uint64(size)
        while size - place >= 8:
            word = _rotated(self.eights[at + place] * _P2, 31) * _P1
            h = _rotated(h ^ word, 27) * _P1 + _P4
            place += 8
        if size - place >= 4:
            h = _rotated(h ^ (self.fours[at + place].astype(np.uint64) * _P1), 23) * _P2 + _P3
            place += 4
        while place < size:
            h = _rotated(h ^ (self.raw[at + place].astype(np.uint64) * _P5), 11) * _P1
            place += 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))

    def equal(self, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the ranges that start at `a` and at `b` hold the same bytes."""
        same = np.ones(len(a), bool)
        open_ = np.flatnonzero(lengths <= LONG)
        place = 0
        while len(open_):
            left = lengths[open_] - place
            differs = self.eights[a[open_] + place] ^ self.eights[b[open_] + place]
            tail = left < 8
            differs[tail] <<= ((8 - left[tail]) * 8).astype(np.uint64)  # what lies behind the range
            same[open_[differs != 0]] = False
            open_ = open_[(differs == 0) & (left > 8)]
            place += 8
        for i in np.flatnonzero(lengths > LONG).tolist():
            x, y, n = int(a[i]), int(b[i]), int(lengths[i])
            same[i] = self.content[x : x + n] == self.content[y : y + n]
        return same


@dataclass
class Segment:
    """Terms of a text, of which the first `carried` belong to the segment before."""

    text: int
    terms: list[bytes]
    carried: int


def segments(texts: list[bytes | None], longest: int) -> Iterator[Segment]:
    """A long text comes in several segments, which overlap by `longest - 1` terms."""
    for number, text in enumerate(texts):
        tail: list[bytes] = []
        for terms in term_pieces(text or b""):
            yield Segment(number, tail + terms, len(tail))
            tail = (tail + terms)[len(tail + terms) - longest + 1 :] if longest > 1 else []


def batches(texts: list[bytes | None], longest: int) -> Iterator[list[Segment]]:
    """Segments, gathered to some `BATCH_BYTES` of terms."""
    out, size = [], 0
    for segment in segments(texts, longest):
        out.append(segment)
        size += sum(map(len, segment.terms)) + len(segment.terms)
        if size >= BATCH_BYTES:
            yield out
            out, size = [], 0
    if out:
        yield out


class GramTable:
    """The n-grams of 1 to `longest` terms of some segments.

    `text`: the text of each occurrence; `slots`: its slot in the table. Per slot, `counts` holds
    the n-gram's occurrences and `buckets` the CRC-32 of its bytes modulo `buckets`; `used` lists
    the slots that are taken.
    """

    def __init__(self, parts: list[Segment], longest: int, buckets: int) -> None:
        data = Bytes(b"\n".join(b" ".join(p.terms) for p in parts))
        sizes = np.fromiter((len(p.terms) for p in parts), np.int64, len(parts))
        blanks = np.flatnonzero(data.raw[: len(data.content)] < 0x30)  # no term has such a byte
        ends = np.append(blanks, len(data.content))
        starts = np.concatenate([[0], ends[:-1] + 1])
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.arange(len(starts)) - first
        new = place >= np.repeat(np.fromiter((p.carried for p in parts), np.int64, len(parts)), sizes)
        text = np.repeat(np.fromiter((p.text for p in parts), np.int64, len(parts)), sizes)
        begins, lengths, owners = [], [], []
        for n in range(1, longest + 1):
            last = np.flatnonzero(new & (place >= n - 1))
            begins.append(starts[last - n + 1])
            lengths.append(ends[last] - begins[-1])
            owners.append(text[last])
        self.data, self.text = data, np.concatenate(owners)
        self._intern(np.concatenate(begins), np.concatenate(lengths))
        self.counts = np.bincount(self.slots, minlength=len(self._holder))
        self.used = np.flatnonzero(self._holder >= 0)
        self.buckets = np.zeros(len(self._holder), np.int64)
        mine = self._holder[self.used]
        self.buckets[self.used] = data.checksums(self._starts[mine], self._lengths[mine]) % buckets

    def _intern(self, starts: np.ndarray, lengths: np.ndarray) -> None:
        self._starts, self._lengths = starts, lengths
        keys = self.data.hashes(starts, lengths)
        room = 1 << max(4, (2 * len(keys)).bit_length())
        step = np.int64(room - 1)
        self._holder = np.full(room, -1, np.int64)  # the occurrence whose bytes the slot stands for
        self.slots = (keys & np.uint64(step)).astype(np.int64)
        waiting = np.arange(len(keys))
        while len(waiting):
            at = self.slots[waiting]
            free = self._holder[at] < 0
            self._holder[at[free]] = waiting[free]  # of several, one stays
            holder = self._holder[at]
            fits = (keys[holder] == keys[waiting]) & (lengths[holder] == lengths[waiting])
            check = np.flatnonzero(fits & (holder != waiting))
            a, b = holder[check], waiting[check]
            fits[check] = self.data.equal(starts[a], starts[b], lengths[b])
            waiting = waiting[~fits]
            self.slots[waiting] = (self.slots[waiting] + 1) & step

    def bucket_counts(self, buckets: int) -> np.ndarray:
        """Occurrences by bucket."""
        out = np.zeros(buckets, np.int64)
        np.add.at(out, self.buckets[self.used], self.counts[self.used])
        return out

    def sums(self, gains: np.ndarray, texts: int) -> np.ndarray:
        """For each text, the sum of its occurrences' gains (whole numbers, by bucket)."""
        of_slot = np.zeros(len(self.buckets), np.int64)
        of_slot[self.used] = gains[self.buckets[self.used]]
        out = np.zeros(texts, np.int64)
        np.add.at(out, self.text, of_slot[self.slots])
        return out
