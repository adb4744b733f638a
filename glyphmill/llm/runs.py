"""Runs of bytes of some kind in a column of texts: found, hashed and gathered for a whole batch at once.

All work is on the UTF-8 bytes of a batch, so texts are neither decoded nor looped over. What is run by run is only what is rare: runs of
more than `LONG` bytes, so that one very long run costs linear time.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LONG = 64
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


@dataclass
class Runs:
    """The runs of a batch: `data` from `start` to `end`, in the text of row `row`; in order."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    def take(self, which: np.ndarray) -> Runs:
        return Runs(self.data, self.start[which], self.end[which], self.row[which])

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def _fold(self, step, out: np.ndarray) -> np.ndarray:
        """`out` after step(out of some runs, their next byte) for each byte of the runs of at most LONG bytes."""
        length = self.end - self.start
        active = np.flatnonzero((length > 0) & (length <= LONG))
        i = 0
        while len(active):
            out[active] = step(out[active], self.data[self.start[active] + i])
            i += 1
            active = active[length[active] > i]
        return out

    def crc32(self, before: np.ndarray | int = 0) -> np.ndarray:
        """The unsigned crc32 of each run, carried on from the crc32 `before` of what stands before it."""
        before = np.broadcast_to(np.asarray(before, np.uint32), self.start.shape)
        out = self._fold(lambda c, b: _CRC[(c ^ b) & np.uint32(255)] ^ (c >> np.uint32(8)), ~before) ^ np.uint32(0xFFFFFFFF)
        for i in np.flatnonzero(self.end - self.start > LONG).tolist():
            out[i] = zlib.crc32(self.data[self.start[i] : self.end[i]].tobytes(), int(before[i]))
        return out

    def hash64(self) -> np.ndarray:
        """A 64-bit hash of each run's bytes."""
        import xxhash

        def step(h: np.ndarray, b: np.ndarray) -> np.ndarray:
            h = (h ^ b) * np.uint64(0x9E3779B97F4A7C15)
            return h ^ (h >> np.uint64(29))

        out = mix(self._fold(step, np.full(len(self.start), 0x51ED270B, np.uint64)))
        for i in np.flatnonzero(self.end - self.start > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]].tobytes())
        return out

    def strings(self) -> pa.Array:
        """The runs as an Arrow array of strings."""
        length = self.end - self.start
        offsets = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=offsets[1:])
        flat = self.data[np.repeat(self.start - offsets[:-1], length) + np.arange(offsets[-1])]
        return pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(flat))


def mix(h: np.ndarray) -> np.ndarray:
    """Bits of `h` spread over all 64 places, one to one."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs of such hashes."""
    return mix(a * np.uint64(0xA0761D6478BD642F) + np.uint64(0x2545F4914F6CDD1D) ^ b)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, A-Z in lower case, and where each text ends in them (nulls are empty)."""
    import pyarrow.compute as pc

    texts = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].copy()
    data[(data >= 65) & (data <= 90)] += 32
    return data, offsets[1:] - offsets[0]


def find(data: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> Runs:
    """The maximal runs of bytes for which `inside` holds, none across the end of a text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Runs(data, none, none, none)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = ends[(ends > 0) & (ends < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    start = np.flatnonzero(first)
    return Runs(data, start, np.flatnonzero(last) + 1, np.searchsorted(ends, start, side="right"))


def words(data: np.ndarray, ends: np.ndarray) -> Runs:
    """Runs of anything but ASCII white space, space and U+0009 to U+000D."""
    return find(data, ends, (data != 32) & ((data < 9) | (data > 13)))
