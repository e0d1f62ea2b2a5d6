"""Benchmark decontamination by embedding edit distance into Hamming distance (operator 1).

Texts are sequences of words (A-Z lower-cased, punctuation at word ends dropped). A document
holds an item of L words if some stretch of it is within ``floor((1 - similarity) L)`` word
edits. For every item length, windows of that length are walked as in the CGK embedding: a
pointer starts at the window's first word, each step reads the word under it and moves on or
stays as a random bit of (repetition, step, word) says, so that few edits change few of the
words read. Bit sampling keeps a few steps of each repetition as the hash; a window and an item
that agree in any repetition are a candidate pair, and a pair is kept only if the exact edit
distance confirms it. The number of repetitions follows, for each length of items, from the target
recall and from the rate at which items of that length with the greatest allowed number of edits
agree with themselves, which is measured on the items.

Windows that cannot hold any item are not walked. This loses nothing: k edits of an item of L
words leave at least L - (n - 1) - n k of its runs of n words, and one run of (L - k) / (k + 1),
in the stretch, whose length is at most L + k; windows are sought around the longest run, which
must be one of an item of that length, and counts of shorter runs tell where enough can be.

Items are a query set of bounded blocks (``BLOCK_ITEMS``), each block a pass over the documents'
words; documents are read whole, in place, without a shuffle.

Defined cases: items of one to four words must stand there word for word; items without words, and
null or empty texts, hold nothing; a null doc_id is reported as null; repeated items and rows are
all reported; documents of a million words are searched whole; other columns are ignored, but kept
by ``decontaminate``; an empty benchmark or document table gives no rows. Ties of distance: the
earliest position is reported.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import tidy, words_of

SIMILARITY, RECALL = 0.8, 0.99
#: Items that travel to the tasks at once: at most about 10 MB.
BLOCK_ITEMS = 20_000
SAMPLED, STEPS_PER_WORD, SEED = 2, 2, 7
#: Words searched at once, and walks (windows times repetitions) that go on together, about.
TOGETHER, LANES = 200_000, 2_000_000
EDGE = b".,;:!?\"'()[]{}<>#%*&$|-_"


class _Normal(dict):
    """Number of a word after normalisation; 0: not a benchmark word, -1: nothing left of it."""

    def __init__(self, numbers: dict[bytes, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        bare = word.strip(EDGE)
        n = self[word] = self.numbers.get(bare, 0) if bare else -1
        return n


def normal_words(text: str | None) -> list[bytes]:
    return [w for w in (x.strip(EDGE) for x in words_of(text)) if w]


def edits_allowed(length: int, similarity: float = SIMILARITY) -> int:
    return math.floor((1 - similarity) * length + 1e-9)


def needed(length: int, edits: int) -> list[int]:
    """Runs of 1, 2, 3 and 4 of an item's words that its stretch keeps at least.

    An edit spoils at most n runs of n; and of the length - edits words kept, which edits part
    into at most edits + 1 runs, some run has the average length or more.
    """
    longest = -(-(length - edits) // (edits + 1))
    return [max(length - (n - 1) - n * edits, int(longest >= n), 0) for n in (1, 2, 3, 4)]


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance of item to any stretch of text, end of the first such stretch)."""
    row = np.zeros(len(text) + 1, np.int32)
    steps = np.arange(len(text) + 1, dtype=np.int32)
    for k, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    end = int(np.argmin(row))
    return int(row[end]), end


class Index:
    """Embeddings of one block of items under all repetitions."""

    def __init__(self, items: list[tuple[int, list[bytes]]], similarity: float, recall: float, rates: dict[int, float] | None = None):
        self.similarity = similarity
        self.numbers: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, words in items:
            if words:
                self.items.append((item, np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int32)))
        self.by_length: dict[int, list[int]] = defaultdict(list)
        for i, (_, words) in enumerate(self.items):
            self.by_length[len(words)].append(i)
        self.runs = {n: np.unique(np.concatenate([self.grams(w, n)[0] for _, w in self.items] or [np.zeros(0, np.int64)])) for n in (1, 2, 3, 4)}
        # which lengths of items have which runs
        self.lengths = sorted(self.by_length)
        self.has = {n: np.zeros((len(table), len(self.lengths)), bool) for n, table in self.runs.items()}
        for _, w in self.items:
            for n, table in self.runs.items():
                self.has[n][np.searchsorted(table, self.grams(w, n)[0]), self.lengths.index(len(w))] = True
        # repetitions by length: the rate at which items with the most edits agree falls with it
        rng, edits = np.random.default_rng(SEED), random.Random(SEED)
        self.samples: dict[int, np.ndarray] = {}
        self.rates = rates or {length: self._rate(length, edits) for length in self.lengths}
        for length, rate in self.rates.items():
            reps = 1 if rate >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - rate)))
            self.samples[length] = np.sort(np.floor(rng.random((reps, SAMPLED)) * STEPS_PER_WORD * length).astype(np.int64), 1)
        self.tables = {length: self._table(length, rows) for length, rows in self.by_length.items()}

    def grams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the runs of n benchmark words, and where they begin."""
        if len(words) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code, ok, m = np.zeros(len(words) - n + 1, np.int64), np.ones(len(words) - n + 1, bool), len(self.numbers) + 1
        for k in range(n):
            part = words[k : k + len(code)]
            code = code * m + part  # may wrap with very many words: then runs are taken for equal that aren't, which costs time only
            ok &= part > 0
        at = np.flatnonzero(ok)
        return code[at], at

    def walk(self, words: np.ndarray, begin: np.ndarray, length: int, wanted: np.ndarray) -> np.ndarray:
        """[sample, repetition, window]: words read at the wanted steps (rows: repetitions) of walks over windows of ``length`` words.

        All windows advance together under all repetitions. A pointer beyond its window's end reads
        -1; words must go on for as many more as there are steps. The random bit of (repetition, step,
        word) is one of the mixed product of word and a number of (repetition, step), so nothing is
        stored for it, however long the items are.
        """
        reps = len(wanted)
        at = np.tile(begin.astype(np.int64), reps)
        turn = np.repeat(np.arange(1, reps + 1, dtype=np.uint32) * np.uint32(0x85EBCA6B), len(begin))
        due = defaultdict(list)
        for r, k in np.ndindex(*wanted.shape):
            due[int(wanted[r, k])].append((k, r))
        out = np.empty((wanted.shape[1], reps, len(begin)), np.int64)
        for step in range(int(wanted.max()) + 1):
            read = words.take(at)
            for k, r in due.get(step, ()):
                lanes = slice(r * len(begin), (r + 1) * len(begin))
                out[k, r] = np.where(at[lanes] < begin + length, read[lanes], -1)
            x = read.astype(np.uint32)
            x += np.uint32((step * 0x9E3779B1 + 0x7F4A7C15) & 0xFFFFFFFF)
            x *= np.uint32(0xC2B2AE35)
            x ^= x >> np.uint32(15)
            x += turn
            x *= np.uint32(0x27D4EB2F)
            x ^= x >> np.uint32(13)
            x *= np.uint32(0x9E3779B1)
            at += x >> np.uint32(31)
        return out

    def hashes(self, words: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
        """One row a repetition: hash of the sampled steps of the windows that begin there."""
        read = self.walk(words, begin, length, self.samples[length])
        out = np.zeros(read.shape[1:], np.int64)
        for rows in read:
            out = out * (len(self.numbers) + 2) + rows + 1
        return out

    def _table(self, length: int, rows: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        words = np.concatenate([*(self.items[i][1] for i in rows), np.zeros(STEPS_PER_WORD * length, np.int32)])
        h = self.hashes(words, np.arange(len(rows)) * length, length)
        order = np.argsort(h, axis=1, kind="stable")
        return [(x[o], np.array(rows)[o]) for x, o in zip(h, order)]

    def _rate(self, length: int, edits: random.Random, trials: int = 200) -> float:
        """Share of repetitions in which items of this length agree with themselves under the most edits allowed; a lower estimate."""
        k = edits_allowed(length, self.similarity)
        if not k:
            return 1.0
        rows = self.by_length[length]
        pairs = []
        for i in range(trials):
            words = self.items[rows[i % len(rows)]][1].tolist()
            changed = list(words)
            for _ in range(k):
                kind, at = edits.randrange(3), edits.randrange(max(1, len(changed)))
                if kind == 0:
                    changed[at] = 0
                elif kind == 1:
                    changed.insert(at, 0)
                elif len(changed) > 1:
                    del changed[at]
            pairs.append((words, changed))
        wanted = np.sort(np.floor(np.random.default_rng(SEED + length).random((16, SAMPLED)) * STEPS_PER_WORD * length).astype(np.int64), 1)
        reads = []
        for side in (0, 1):
            size = (STEPS_PER_WORD + 2) * length + k
            words = np.zeros(size * trials, np.int32)
            for i, p in enumerate(pairs):
                words[i * size : i * size + len(p[side])] = p[side]
            reads.append(self.walk(words, np.arange(trials) * size, length, wanted))
        agree = (reads[0] == reads[1]).all(0).sum()
        # two standard errors below what was seen, so that the repetitions are not too few
        rate = agree / (16 * trials)
        return max(rate - 2 * math.sqrt(rate * (1 - rate) / trials), 1 / (16 * trials))

    def _known(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the words have a run of n that some item has, and the number of that run."""
        code, at = self.grams(words, n)
        table = self.runs[n]
        if not len(code) or not len(table):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(table, code), len(table) - 1)
        same = table[k] == code
        return at[same], k[same]

    def windows(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item length, starts of windows that could hold such an item); words end in enough zeros."""
        n = len(words)
        found = {size: self._known(words, size) for size in self.runs}
        sums = []
        for size in (1, 2):
            x = np.zeros(n + 1, np.int32)
            x[found[size][0] + 1] = 1
            sums.append(np.cumsum(x, dtype=np.int32))
        for i, length in enumerate(self.lengths):
            k = edits_allowed(length, self.similarity)
            need = needed(length, k)
            size = max(m for m in (1, 2, 3, 4) if need[m - 1] > 0)
            at, which = found[size]
            at = at[self.has[size][which, i]]  # the run must be one of an item of this length
            if not len(at):
                continue
            reach = length + k
            starts = np.unique(at[:, None] - np.arange(reach - size + 1))
            starts = starts[starts >= 0]
            end = np.minimum(starts + reach, n)
            ok = np.searchsorted(at, end - size, "right") - np.searchsorted(at, starts, "left") >= need[size - 1]
            for s, least in zip(sums, need):
                if least > 0:
                    ok &= s[end] - s[starts] >= least
            if ok.any():
                yield length, starts[ok]

    def search(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edit distance, words of the item, end of the stretch) of all items that the texts hold."""
        if not self.items or not texts:
            return []
        gap = np.zeros(2 * max(self.by_length) + 1, np.int32)  # no window that could hold an item reaches over it
        words = np.concatenate([x for t in texts for x in (t.astype(np.int32), gap)])
        first = np.concatenate([[0], np.cumsum([len(t) + len(gap) for t in texts])])
        near: dict[tuple[int, int], set[int]] = defaultdict(set)
        for length, starts in self.windows(words):
            for lot in np.array_split(starts, -(-len(starts) * len(self.samples[length]) // LANES)):
                for h, (table, rows) in zip(self.hashes(words, lot, length), self.tables[length]):
                    lo, hi = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
                    hit = hi > lo
                    for s, a, b in zip(lot[hit], lo[hit], hi[hit]):
                        text = int(np.searchsorted(first, s, "right")) - 1
                        for row in rows[a:b]:
                            near[text, int(row)].add(int(s - first[text]))
        out = []
        for (text, row), starts in near.items():
            item, w = self.items[row]
            k = edits_allowed(len(w), self.similarity)
            best = None
            for lo, hi in _merged(sorted(starts), k, len(w) + k, len(texts[text])):
                if np.isin(w, texts[text][lo:hi]).sum() < len(w) - k:
                    continue  # too few of its words are there at all
                d, end = best_stretch(w, texts[text][lo:hi])
                if d <= k and (best is None or (d, lo + end) < best):
                    best = (d, lo + end)
            if best:
                out.append((text, item, best[0], len(w), best[1]))
        return out


def _merged(starts: list[int], before: int, after: int, n: int) -> Iterator[tuple[int, int]]:
    """Stretches around window starts, joined where they overlap."""
    lo = hi = None
    for s in starts:
        a, b = max(0, s - before), min(n, s + after)
        if lo is not None and a <= hi:
            hi = max(hi, b)
        else:
            if lo is not None:
                yield lo, hi
            lo, hi = a, b
    if lo is not None:
        yield lo, hi


def _numbered(texts: pa.Array, number: _Normal) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first, last, words as numbers) of slices of a column of about TOGETHER words."""
    lo, out, count = 0, [], 0
    for k, text in enumerate(texts):
        raw = words_of(text.as_py())
        words = np.fromiter(map(number.__getitem__, raw), np.int32, len(raw))
        out.append(words[words >= 0])
        count += len(words)
        if count >= TOGETHER:
            yield lo, k + 1, out
            lo, out, count = k + 1, [], 0
    if out:
        yield lo, len(texts), out


def _shared(docs: DataFrame, items: list[tuple[int, list[bytes]]], similarity: float, recall: float):
    """What a task builds its index from: at most BLOCK_ITEMS items, and the rates, which are measured once."""
    return docs.sparkSession.sparkContext.broadcast((items, similarity, recall, Index(items, similarity, recall).rates))


def _pass(docs: DataFrame, items: list[tuple[int, list[bytes]]], similarity: float, recall: float) -> DataFrame:
    fields = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edit_distance", pa.int32()), ("item_words", pa.int32()), ("end_word", pa.int64())])
    shared = _shared(docs, items, similarity, recall)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        number = _Normal(index.numbers)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, _, texts in _numbered(batch.column(1), number):
                rows = [(ids[lo + k], *x) for k, *x in index.search(texts)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields)

    return docs.mapInArrow(tidy(run), "doc_id bigint, item_id bigint, edit_distance int, item_words int, end_word bigint")


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items with at least a word, in blocks of BLOCK_ITEMS; one empty block if there are none."""
    block, any_ = [], False
    for row in benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text is not null").toLocalIterator():
        block.append((row.item_id, normal_words(row.text)))
        if len(block) == BLOCK_ITEMS:
            yield block
            block, any_ = [], True
    if block or not any_:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, edit_distance, item_words, end_word: the items that each document holds, best stretch each."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text is not null")
    passes = [_pass(docs, block, similarity, recall) for block in _blocks(benchmark)]
    return reduce(DataFrame.unionByName, passes)


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns. Every row is judged by its own text, whatever its doc_id."""
    text = docs.columns.index("text")
    out = docs
    for block in _blocks(benchmark):
        out = out.mapInArrow(tidy(_without(_shared(docs, block, similarity, recall), text)), docs.schema)
    return out


def _without(shared, text: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        number = _Normal(index.numbers)
        for batch in batches:
            bad = np.zeros(len(batch), bool)
            for lo, hi, texts in _numbered(batch.column(text), number):
                bad[[lo + k for k, *_ in index.search(texts)]] = True
            yield batch.filter(pa.array(~bad))

    return run
