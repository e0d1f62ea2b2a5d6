"""Token ids of whole texts through the tokenizers library.

The vocabulary's path is a parameter, and texts come out with exactly the ids of
``Tokenizer.encode(text, add_special_tokens=False)``. Where the vocabulary's own rules allow it
(``_parts``: they are read from its file, not assumed), a text is cut into chunks, each distinct
chunk is encoded once by the library and its ids are remembered up to a bound; all else is done
on the bytes of a whole Arrow column in numpy. Under any other rules whole texts are encoded.

The rules say: white space parts chunks and leaves no id; letters, single digits and runs of
signs are parted from each other, but for the apostrophe's endings; case does not matter. So a
cut is made between an ASCII letter (or Latin-1 letter), digit or sign and the next one of another
kind, never beside an apostrophe, a control sign or any other character. Only A-Z is lower-cased
first, and not before a character that it might be composed with. Texts with ``<|`` are cut at
white space only, as special tokens are matched as written. Chunks are told apart by hash, then
by their first 16 and last 8 bytes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import KEPT

#: Bytes that are cut and looked up together.
LOT = 1_000_000
_SPACE, _LETTER, _DIGIT, _SIGN, _QUOTE, _OTHER = range(6)
# The rules under which chunks may be encoded apart.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _kinds() -> np.ndarray:
    kind = np.full(256, _OTHER, np.uint8)
    for c in range(33, 127):
        kind[c] = _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _QUOTE if c == 39 else _SIGN
    kind[[9, 10, 13, 32]] = _SPACE
    return kind


def _cuts() -> np.ndarray:
    """Whether a chunk begins at a byte, by 6 * kind of the byte before + own kind."""
    cut = np.zeros(36, bool)
    cut[1:6] = True  # after white space
    for a, b in ((_LETTER, _DIGIT), (_LETTER, _SIGN), (_DIGIT, _LETTER), (_DIGIT, _DIGIT), (_DIGIT, _SIGN), (_SIGN, _LETTER), (_SIGN, _DIGIT)):
        cut[6 * a + b] = True
    return cut


_KIND, _CUT = _kinds(), _cuts()
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: What the library itself must normalise or part within a chunk: quotes and all that is neither ASCII nor a small Latin-1 letter.
_ODD = np.isin(_KIND, (_QUOTE, _OTHER))
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_M1, _M2, _32 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


def _parts(rules: dict) -> bool:
    """Whether these rules let chunks be encoded apart."""
    first, split = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
    steps = split.get("pretokenizers", [])
    return (
        first.get("normalizers") == _NORMALIZERS and len(steps) == 2 and steps[0] == {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
        and steps[1].get("type") == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and not rules.get("post_processor") and not rules.get("truncation")
        and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in rules.get("added_tokens", []))
    )


class Pieces:
    """Ids of chunks in growing arrays, found by an open-addressed table; forgotten when there are more than ``bound``."""

    def __init__(self, path: str, bound: int = 1_000_000, parts: bool | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.bound = Tokenizer.from_file(path), bound
        if parts is None:
            with open(path, encoding="utf-8") as f:
                parts = _parts(json.load(f))
        self.parts = parts
        # the model alone, for chunks that the rules neither change nor part
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # bytes of each id, as byte-level tokens have a character a byte: they tell where chunks end, which the fast way of encoding does not
        vocabulary, suffix = self.bare.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(t.removesuffix(suffix)) for t in vocabulary]
        self.clear()

    def clear(self) -> None:
        self.count, self.used, self.bits = 0, 0, 16
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.seen = np.zeros((1 << 14, 4), np.uint64)  # first, second and last eight bytes, length
        self.key, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)

    def __call__(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text; null: none."""
        ids, ends = self.column(pa.array(texts, pa.string()))
        return np.split(ids, ends[:-1]) if len(ends) else []

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids (uint32) of all texts in sequence, end of each text's ids)."""
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.parts:
            found = [e.ids for lo in range(0, len(texts), 256) for e in self.tokenizer.encode_batch(texts.slice(lo, 256).to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.array(x, np.uint32) for x in found]), np.cumsum([len(x) for x in found])
        texts = texts.cast(pa.large_string())
        _, place, data = texts.buffers()
        offsets = np.frombuffer(place, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        out, at, numbers = [], [], []
        for lo, hi in _lots(raw, offsets):
            begin, n, ids = self._lot(raw, offsets, lo, hi)
            at.append(begin + lo)
            numbers.append(n)
            out.append(ids)
        if not out:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        before = np.concatenate([[0], np.cumsum(np.concatenate(numbers))])
        return np.concatenate(out), before[np.searchsorted(np.concatenate(at), offsets[1:], "left")]

    def _lot(self, raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin of each chunk in raw[lo:hi], its number of ids, all ids)."""
        own = raw[lo:hi]
        n = len(own)
        low = np.zeros(n + 16, np.uint8)
        low[:n] = _mapped(own, _LOWER)
        kind = np.zeros(n + 2, np.uint8)  # white space around
        kind[1:-1] = _mapped(own, _KIND)
        odd = _mapped(own, _ODD).astype(bool)
        if own.max(initial=0) >= 128:
            high = np.flatnonzero(own[:-1] == 0xC3)
            high = high[(own[high + 1] != 0x97) & (own[high + 1] != 0xB7)]
            kind[high + 1] = kind[high + 2] = _LETTER
            odd[high] = odd[high + 1] = False
            odd[high[own[high + 1] < 0x9F]] = True  # capitals
            marks = np.flatnonzero(own[1:] >= 0xC4)  # what may be a combining mark
            low[marks] = own[marks]
            odd[marks] = True
        special = np.flatnonzero((own[:-1] == 60) & (own[1:] == 124))
        for doc in np.unique(np.searchsorted(offsets, special + lo, "right") - 1):
            a, b = max(0, offsets[doc] - lo), min(n, offsets[doc + 1] - lo)
            low[a:b] = own[a:b]
            odd[a:b] = True
            kind[a + 1 : b + 1][kind[a + 1 : b + 1] != _SPACE] = _OTHER
        starts = _mapped(kind[:-1] * np.uint8(6) + kind[1:], _CUT).astype(bool)
        first = offsets[(offsets >= lo) & (offsets < hi)] - lo
        starts[first[kind[first + 1] != _SPACE]] = True
        begin = np.flatnonzero(starts)
        # a chunk ends where the next one begins or white space does
        gap = kind[1:] == _SPACE
        end = np.flatnonzero((kind[:-1] != _SPACE) & (gap | starts))
        which = self._find(low, begin, end - begin, odd)
        size = self.size[which]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return begin, size, self.flat[np.arange(total) + np.repeat(self.begin[which] - (ends - size), size)]

    def _find(self, low: np.ndarray, begin: np.ndarray, size: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Entries of the chunks, learnt where they are new."""
        if not len(begin):
            return begin
        eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
        words = eight[begin] & _MASK[np.minimum(size, 8)]
        h = (words ^ (size.astype(np.uint64) * _M2)) * _M1
        h ^= h >> _32
        long = np.flatnonzero(size > 8)
        second, last = eight[begin[long] + 8] & _MASK[np.minimum(size[long] - 8, 8)], eight[(begin + size)[long] - 8]
        some = np.flatnonzero(size[long] <= 64)
        for k in range(1, 8):
            some = some[size[long[some]] > 8 * k]
            if not len(some):
                break
            at = long[some]
            x = (h[at] ^ (eight[begin[at] + 8 * k] & _MASK[np.minimum(size[at] - 8 * k, 8)])) * _M1
            h[at] = x ^ (x >> _32)
        for i in np.flatnonzero(size > 64).tolist():
            h[i] = xxhash.xxh3_64_intdigest(low[begin[i] : begin[i] + size[i]])
        h *= _M2
        h ^= h >> _32
        h |= np.uint64(1)  # 0 marks a free place
        which = self._look_up(h)
        new = np.flatnonzero(which < 0)
        if len(new):
            _, some = np.unique(h[new], return_index=True)
            if self.count + len(some) > self.bound:
                self.clear()
                new = np.arange(len(h))
                _, some = np.unique(h, return_index=True)
            some = new[np.sort(some)]  # in order of text, as sorted hashes would crowd the table
            seen = np.zeros((len(some), 4), np.uint64)
            seen[:, 0], seen[:, 3] = words[some], size[some]
            far = np.searchsorted(long, some)
            far = np.where((far < len(long)) & (long[np.minimum(far, len(long) - 1)] == some), far, -1) if len(long) else np.full(len(some), -1)
            seen[far >= 0, 1], seen[far >= 0, 2] = second[far[far >= 0]], last[far[far >= 0]]
            plain = ~_any(odd, begin[some], size[some])
            for kind in (True, False):
                of = np.flatnonzero(plain == kind)
                self._learn(_strings(low, begin[some[of]], size[some[of]]), h[some[of]], seen[of], self.bare if kind else self.tokenizer)
            which[new] = self._look_up(h[new])
        # equal hashes of different chunks: the chunk gets an entry of its own, which no hash finds
        wrong = (self.seen[:, 0][which] != words) | (self.seen[:, 3][which] != size.astype(np.uint64))
        wrong[long] |= (self.seen[:, 1][which[long]] != second) | (self.seen[:, 2][which[long]] != last)
        for i in np.flatnonzero(wrong).tolist():
            which[i] = self.count
            self._learn(_strings(low, begin[i : i + 1], size[i : i + 1]), None, np.zeros((1, 4), np.uint64), self.tokenizer)
        return which

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash; -1: none."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.key[slot]
        out = np.where(found == h, self.entry[slot], -1)
        left = np.flatnonzero((found != h) & (found != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.key[slot[left]]
            hit = found == h[left]
            out[left[hit]] = self.entry[slot[left[hit]]]
            left = left[~hit & (found != 0)]
        return out

    def _insert(self, h: np.ndarray, entry: np.ndarray) -> None:
        """Put distinct hashes in the table: of those that meet at a place, one stays and the others go on."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.key[slot] == 0)
            self.key[slot[free]] = h[free]
            here = self.key[slot] == h
            self.entry[slot[here]] = entry[here]
            h, entry, slot = h[~here], entry[~here], (slot[~here] + 1) & ((1 << self.bits) - 1)

    def _encoded(self, new: list[str], library) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all these chunks, number of ids of each)."""
        if library is self.bare:
            ids = np.array(library.encode_batch_fast([new], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            upto, ends = np.cumsum(self.bytes[ids]), np.cumsum([len(x.encode()) for x in new])
            last = np.searchsorted(upto, ends, "right") - 1
            if len(ids) and upto[-1] == ends[-1] and (upto[last] == ends).all():
                return ids, np.diff(last, prepend=-1)
        e = library.encode(new, is_pretokenized=True, add_special_tokens=False)
        return np.array(e.ids, np.uint32), np.bincount(np.array(e.word_ids, np.int64), minlength=len(new))

    def _learn(self, new: list[str], h: np.ndarray | None, seen: np.ndarray, library) -> None:
        for lo in range(0, len(new), 16_384):  # in lots, as encodings take far more memory than their ids
            ids, size = self._encoded(new[lo : lo + 16_384], library)
            n = len(size)
            first = self.count
            while first + n > len(self.begin):
                self.begin, self.size, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.seen))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.size[first : first + n] = size
            self.begin[first : first + n] = self.used + np.cumsum(size) - size
            self.seen[first : first + n] = seen[lo : lo + n]
            self.used, self.count = self.used + len(ids), first + n
            if h is not None:
                if 2 * self.count > 1 << self.bits:
                    old, entry = self.key[self.key != 0], self.entry[self.key != 0]
                    self.bits = int(2 * self.count).bit_length() + 1
                    self.key, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
                    self._insert(old, entry)
                self._insert(h[lo : lo + n], np.arange(first, first + n, dtype=np.int32))


def _mapped(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The table's entry of each byte."""
    return np.frombuffer(x.tobytes().translate(table.astype(np.uint8).tobytes().ljust(256, b"\0")), np.uint8)


def _any(marked: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether any byte of each range is marked."""
    upto = np.concatenate([[0], np.cumsum(marked, dtype=np.int32)])
    return upto[begin + size] > upto[begin]


def _strings(low: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[str]:
    data = low.tobytes()
    return [data[b : b + n].decode("utf-8", "replace") for b, n in zip(begin.tolist(), size.tolist())]


_pieces: dict[str, Pieces] = {}
KEPT["pieces"] = _pieces.clear


def pieces_of(path: str) -> Pieces:
    """This process's pieces of a vocabulary: what one task has learnt serves the next task of the same worker."""
    if path not in _pieces:
        _pieces.clear()
        _pieces[path] = Pieces(path)
    return _pieces[path]


def _lots(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about LOT bytes that end where a text does or at white space."""
    lo = 0
    while lo < len(raw):
        hi = min(len(raw), lo + LOT)
        if hi < len(raw):
            k = int(np.searchsorted(offsets, hi, "right")) - 1
            if offsets[k] > lo:
                hi = int(offsets[k])
            else:  # within one long text
                end = int(offsets[k + 1])
                while hi < end:
                    part = np.flatnonzero(_KIND[raw[hi : min(end, hi + 65_536)]] == _SPACE)
                    if len(part):
                        hi += int(part[0])
                        break
                    hi = min(end, hi + 65_536)
        yield lo, hi
        lo = hi
