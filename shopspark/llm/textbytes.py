"""Hash the words of whole batches of texts at once.

Texts stay in the byte buffer of their Arrow column. Words are found by a table
over bytes and hashed together, a bounded slice at a time, so a text of any
length costs one byte of marks per byte and a fixed amount on top.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (two multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


class WordHasher:
    """Hashes of words, equal for equal words after lower-casing A-Z."""

    def __init__(self, separators: np.ndarray = SPACE, lower: bool = True):
        codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        codes = codes[LOWER] if lower else codes
        self.is_word = ~separators
        self.codes = np.where(separators, np.uint64(0), codes)
        self._grow(SLICE_BYTES)

    def _grow(self, n: int) -> None:
        self.up = _powers(_BASE | 1, n)
        self.down = _powers(pow(_BASE | 1, -1, 1 << 64), n)

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions at which words start; texts do not run into each other."""
        inside = self.is_word[data]
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1]
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        fresh[firsts] = inside[firsts]
        return np.flatnonzero(fresh)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and for each text the number of words before it."""
        starts = self.starts(data, offsets)
        counts = np.searchsorted(starts, offsets)
        # A word's bytes end before the next word of its text or the end of the text.
        ends = np.append(starts[1:], len(data))
        last = counts[1:][counts[1:] > counts[:-1]] - 1
        ends[last] = offsets[1:][counts[1:] > counts[:-1]]
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
            low, high = starts[at], ends[to - 1]
            if high - low > len(self.up):
                self._grow(int(high - low))
            terms = self.codes[data[low:high]] * self.up[: high - low]
            local = starts[at:to] - low
            out[at:to] = np.add.reduceat(terms, local) * self.down[local]
            at = to
        return mix(out), counts


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, places, data = texts.buffers()
    if not len(texts) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``limit`` bytes of text, one row at least."""
    _, offsets = flat(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def shingles(words: np.ndarray, counts: np.ndarray, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``size`` words.

    A text with fewer words has its whole sequence as its one member; a text
    without words has none.
    """
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    whole = max(0, len(words) - size + 1)
    runs = np.zeros(whole, np.uint64)
    for j in range(size):
        runs += words[j : j + whole] * factors[j]
    runs = mix(runs)
    sets = []
    for low, high in zip(counts[:-1].tolist(), counts[1:].tolist()):
        if high - low >= size:
            sets.append(np.unique(runs[low : high - size + 1]))
        elif high > low:
            terms = np.append(words[low:high] * factors[: high - low], np.uint64(high - low))
            sets.append(mix(terms.sum(dtype=np.uint64, keepdims=True)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets
