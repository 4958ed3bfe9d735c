"""Words of whole Arrow text columns, and their hashes, computed on the column's own bytes.

A word is a run of bytes other than space and 0x09 to 0x0D. These separators are ASCII, so a run of
bytes in UTF-8 is a run of code points too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Bytes of text that are hashed at a time, unless a single text is longer.
CHUNK_BYTES = 1 << 20

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_S32, _S29 = np.uint64(32), np.uint64(29)
# Longer words are hashed one by one.
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _S32)) * _M1
    x = (x ^ (x >> _S29)) * _M2
    return x ^ (x >> _S32)


class Words:
    """Where the words of a slice of texts begin and end.

    `bytes` holds all texts one after the other with some zeros behind them, `first` the number of
    the first word of each text (and, last, the number of words).
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        begin, end = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
        self.bytes = np.zeros(end - begin + 8, np.uint8)
        if end > begin:
            self.bytes[:-8] = np.frombuffer(texts.buffers()[2], np.uint8)[begin:end]
        if lower:
            self.bytes = _LOWER[self.bytes]
        self.text_at = offsets - begin if n else np.zeros(1, np.int64)
        inside = np.zeros(end - begin + 2, bool)
        inside[1:-1] = _WORD[self.bytes[:-8]]
        cut = np.zeros(end - begin + 1, bool)
        cut[self.text_at] = True
        self.start = np.flatnonzero(inside[1:] & (cut | ~inside[:-1]))
        self.end = np.flatnonzero(inside[:-1] & (cut | ~inside[1:]))
        self.first = np.searchsorted(self.start, self.text_at)

    def text(self, i: int) -> bytes:
        return self.bytes[self.text_at[i] : self.text_at[i + 1]].tobytes()

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of every word."""
        length = self.end - self.start
        eight = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, strides=(1,))
        out = mix(length.astype(np.uint64) * _STEP + np.uint64(seed * 2 + 1))
        rows, at, left = slice(None), self.start, length
        for _ in range(0, _LONG, 8):
            keep = ((8 - np.clip(left, 0, 8)) * 8).astype(np.uint64)
            out[rows] = mix(out[rows] ^ (eight[at] & (_ALL >> keep)))
            more = left > 8
            if not more.any():
                break
            rows = np.flatnonzero(more) if isinstance(rows, slice) else rows[more]
            at, left = at[more] + 8, left[more] - 8
        for i in np.flatnonzero(length > _LONG):
            out[i] = xxhash.xxh64_intdigest(self.bytes[self.start[i] : self.end[i]].tobytes(), seed)
        return out

    def runs(self, k: int) -> np.ndarray:
        """The numbers of the words at which `k` words of one text begin."""
        room = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.start))
        return np.flatnonzero(room >= k)

    def owner(self) -> np.ndarray:
        """The text of every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def sequences(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every `k` consecutive words; those past the last full run are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * _STEP + hashes[j : j + n]
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], column: str | int = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about CHUNK_BYTES of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size) - size) // CHUNK_BYTES
        at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:]):
            yield batch.slice(a, b - a)
