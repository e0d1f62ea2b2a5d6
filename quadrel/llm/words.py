"""Words of whole Arrow columns as 64-bit hashes, on bytes in numpy.

A word is a maximal run of bytes other than ``\\x20 \\x09-\\x0D``, with A-Z lower-cased, as in
``common.words_of``. Hashes are the same in every task and every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of texts that are taken together; a longer text is taken alone.
LOT = 4_000_000
#: Bytes before and after the texts, so that eight bytes can be read anywhere near a word.
PAD = 16
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_M1, _M2, _32 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


class Words:
    """``hash`` of every word, ``ends`` (words up to the end of each text), and where words lie in ``low``, the lower-cased bytes."""

    def __init__(self, texts: pa.Array):
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        texts = texts.cast(pa.large_string())
        _, place, data = texts.buffers()
        offsets = np.frombuffer(place, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        self.low = np.zeros(len(raw) + 2 * PAD, np.uint8)
        self.low[PAD : PAD + len(raw)] = _LOWER[raw]
        solid = np.zeros(len(raw) + 2, bool)
        np.logical_not(_WHITE[raw], out=solid[1:-1])
        starts = solid[1:] & ~solid[:-1]
        first = offsets[:-1][offsets[:-1] < len(raw)]
        starts[first] |= solid[first + 1]  # a text's first byte begins a word even if the text before ends in one
        stops = solid[:-1] & ~solid[1:]
        stops[first] |= solid[first]
        self.begin = np.flatnonzero(starts) + PAD
        self.size = np.flatnonzero(stops) + PAD - self.begin
        self.ends = np.searchsorted(self.begin, offsets[1:] + PAD, "left")
        self.hash = hashes(self.low, self.begin, self.size)

    def __len__(self) -> int:
        return len(self.ends)

    def of(self, text: int) -> slice:
        """Where the words of one text stand."""
        return slice(int(self.ends[text - 1]) if text else 0, int(self.ends[text]))


def hashes(low: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each range of bytes; eight bytes beyond each must be readable."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
    with np.errstate(over="ignore"):
        h = ((eight[begin] & MASK[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _M2)) * _M1
        h ^= h >> _32
        some = np.flatnonzero((size > 8) & (size <= 64))
        for k in range(1, 8):
            x = (h[some] ^ (eight[begin[some] + 8 * k] & MASK[np.minimum(size[some] - 8 * k, 8)])) * _M1
            h[some] = x ^ (x >> _32)
            some = some[size[some] > 8 * (k + 1)]
            if not len(some):
                break
        for i in np.flatnonzero(size > 64).tolist():
            h[i] = xxhash.xxh3_64_intdigest(low[begin[i] : begin[i] + size[i]])
        h *= _M2
        h ^= h >> _32
    return h


def hash_word(word: bytes) -> int:
    """Hash of one word, lower-cased already."""
    return int(hashes(np.frombuffer(word + bytes(PAD), np.uint8), np.zeros(1, np.int64), np.array([len(word)]))[0])


def lots(texts: pa.Array, most: int = LOT) -> Iterator[tuple[int, int, Words]]:
    """(first, last, words) of slices of a column of at most about ``most`` bytes."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    lo = 0
    while lo < len(texts):
        base = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, "right")))
        yield lo, hi, Words(texts.slice(lo, hi - lo))
        lo = hi


class Table:
    """Open-addressed table from distinct hashes to their positions."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.key, self.entry = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        h, entry = keys.astype(np.uint64), np.arange(len(keys), dtype=np.int32)
        slot = self._slot(h)
        while len(h):
            free = np.flatnonzero(self.entry[slot] < 0)
            self.key[slot[free]], self.entry[slot[free]] = h[free], entry[free]
            here = self.entry[slot] == entry
            h, entry, slot = h[~here], entry[~here], (slot[~here] + 1) & ((1 << self.bits) - 1)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash among the keys; -1: not one of them."""
        slot = self._slot(h)
        out = self.entry[slot]
        left = np.flatnonzero((out >= 0) & (self.key[slot] != h))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.entry[slot[left]]
            left = left[(out[left] >= 0) & (self.key[slot[left]] != h[left])]
        return out
