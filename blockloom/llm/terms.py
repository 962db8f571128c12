"""Terms of whole batches of texts as numpy arrays: split, pack into words, sort by radix, look up."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
# The first k bytes of a little-endian word.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 marks: the bytes in the ranges, both ends included, and all of characters outside ASCII."""
    found = np.zeros(256, bool)
    found[0x80:] = True
    for first, last in ranges:
        found[first : last + 1] = True
    return found


@dataclass
class Terms:
    """Terms in the order of the text: ``size[i]`` bytes of ``data`` from ``start[i]`` on, in row ``row[i]``.

    ``data`` is in ASCII lower case and ends with zeros, so that words can be read past the last term.
    """

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    row: np.ndarray

    def word(self, which: np.ndarray, at: int) -> np.ndarray:
        """Bytes ``8 * at`` to ``8 * at + 7`` of terms as one number each, zero where the term has ended."""
        begin = self.start[which] + 8 * at
        aligned = self.data.view("<u8")
        place, bits = begin >> 3, ((begin & 7) << 3).astype(np.uint64)
        # Two shifts, because shifting by all 64 bits is not defined.
        high = (aligned[place + 1] << (np.uint64(63) - bits)) << np.uint64(1)
        return ((aligned[place] >> bits) | high) & KEEP[np.clip(self.size[which] - 8 * at, 0, 8)]

    def padded(self, which: np.ndarray, width: int) -> np.ndarray:
        """Terms of ``width`` bytes at most as a sortable array of byte strings."""
        out = np.zeros((len(which), width), np.uint8)
        size = self.size[which]
        place = self._places(which)
        out[np.repeat(np.arange(len(which)), size), place - np.repeat(self.start[which], size)] = self.data[place]
        return out.view(f"S{width}").reshape(-1)

    def strings(self, which: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(self.size[which])])
        body = self.data[self._places(which)]
        kind, width = (pa.string(), np.int32) if offsets[-1] < 2**31 else (pa.large_string(), np.int64)
        parts = [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(body)]
        return pa.Array.from_buffers(kind, len(which), parts).cast(pa.string())

    def _places(self, which: np.ndarray) -> np.ndarray:
        size = self.size[which]
        before = np.cumsum(size) - size
        return np.repeat(self.start[which] - before, size) + np.arange(int(size.sum()))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash per term; equal terms have equal ones."""
        out = (self.size.astype(np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
        left, at = np.arange(len(self.start)), 0
        while len(left):
            out[left] = mixed(out[left] ^ self.word(left, at))
            at += 1
            left = left[self.size[left] > 8 * at]
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
        return h ^ (h >> np.uint64(32))


def split(texts: pa.Array, member: np.ndarray) -> Terms:
    """The maximal runs of ``member`` bytes of every text, in lower case; nulls have none."""
    texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    first, end = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    n = end - first
    data = np.zeros((n + 31) // 8 * 8, np.uint8)
    if n:
        data[:n] = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[first:end]]
    inside = member[data[:n]]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    # A text does not go on in the next one.
    borders = offsets - first
    before[borders[borders < n]] = False
    after[borders[borders > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    size = np.flatnonzero(inside & ~after) + 1 - start
    return Terms(data, start, size, np.searchsorted(borders, start, side="right") - 1)


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by several words, the first one most significant, 16 bits at a time."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word[order] >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit, kind="stable")]
    return order
