"""Toxicity by noisy-channel deobfuscation (operator 6).

A character trigram model is counted over all documents. Each white-space chunk that may hide a
word (letters mixed with digits or signs, letters repeated, single letters in a row) becomes a
lattice: a sign may stand for a letter, a separator may be dropped or be a space, a run of one
letter may be that letter once or twice. Viterbi decoding finds the likeliest restored text
under channel and character model. The restored text is scored by a logistic model over words
and word beginnings, chosen by likelihood ratio and fitted on labelled documents whose
crc32(doc_id) mod 5 is not 0, at most ``FIT_DOCS`` of them (the smallest by hash).

Only text is an input of a score. Chunks are decoded once and remembered up to a bound. A chunk of
letters without three equal ones in a row is its own likeliest reading, as its lattice offers no
other, so it is taken as it stands. The number of features follows the labelled texts, which are
bounded.

Defined cases: null, empty or white text scores the intercept; chunks and runs of single letters
of every length are decoded whole, chunks over ``LONGEST`` characters also piece by piece between
their separators, as no word is that long; a null doc_id is not held out; null
labels are left out; other columns are ignored, but kept by ``drop_toxic``; repeated rows are scored each; without labels of both kinds every score is
the share of toxic labels, or 0.5 without any; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import tidy

FIT_DOCS, LONGEST = 20_000, 24
# What a sign may stand for.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
DROPPED = set(".-_*'~/\\,:;·•^=")
EDGES = ".,;:!?#%*&$|()[]{}<>\"'`~-_=+/\\"
#: Symbols of the character model: boundary, a-z, other letters in 8 classes, digit, other.
SYMBOLS = 37
SINGLES = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
RUN = re.compile(r"(.)\1\1")
SEPARATORS = re.compile(f"[{re.escape(''.join(sorted(DROPPED)))}|?&+<>()\\[\\]{{}}\"]+")


def _symbol_table() -> np.ndarray:
    table = np.full(0x300, 36, np.int64)
    for cp in range(0x300):
        c = chr(cp)
        if "a" <= c <= "z":
            table[cp] = cp - 96
        elif c.isalpha():
            table[cp] = 27 + cp % 8
        elif c.isdigit():
            table[cp] = 35
        elif c.isspace():
            table[cp] = 0
    table[0x2FF] = 36
    return table


SYMBOL = _symbol_table()


def symbols(text: str) -> np.ndarray:
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return SYMBOL[np.minimum(cps, 0x2FF)]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of symbol triples over all texts: SYMBOLS**3 numbers, whatever the size of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                s = np.concatenate([[0, 0], symbols((text.as_py() or "").lower()), [0]])
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[k], pa.int64())], ["k", "n"])

    rows = docs.select("text").mapInArrow(tidy(run), "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS**3)
    for r in rows:
        out[r["k"]] = r["n"]
    return out


class CharModel:
    """log P(c | a, b), smoothed by shorter contexts."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 1) / (one.sum() + SYMBOLS)
        p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
        p3 = (three + 10 * p2[None]) / (three.sum(2, keepdims=True) + 10)
        self.log = np.log(p3).tolist()


def _code(c: str) -> int:
    return int(SYMBOL[min(ord(c), 0x2FF)])


def lattice(chunk: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters, what it may have been, with the channel's log probability."""
    out = []
    for m in re.finditer(r"(.)\1*", chunk, re.S):
        c, n = m[1], len(m[0])
        if c.isalpha():
            options = [(c, 0.0)] if n == 1 else [(c * 2, -0.5 if n > 2 else -0.05), (c, -0.7 if n > 2 else -8.0)]
            if n > 2:
                options.append((c * n, -6.0))
        else:
            options = [(c * min(n, 3), -6.0)]
            for to in STANDS_FOR.get(c, ""):
                options.append((to, -1.5 - math.log(len(STANDS_FOR[c]))))
                if n > 1:
                    options.append((to * 2, -2.5 - math.log(len(STANDS_FOR[c]))))
            if c in DROPPED or c.isspace():
                options += [("", -0.7), (" ", -1.2 if c.isspace() else -3.0)]
        out.append(options)
    return out


def decode(chunk: str, model: CharModel) -> str:
    """The likeliest restored text of a chunk (Viterbi over pairs of symbols)."""
    log = model.log
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # a text is what was emitted last and the text before: linear in length
    for options in [*lattice(chunk), [(" ", 0.0)]]:
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, text) in best.items():
            for emitted, cost in options:
                s, x, y = score + cost, a, b
                for c in emitted:
                    z = _code(c)
                    s += log[x][y][z]
                    x, y = y, z
                if (x, y) not in new or s > new[x, y][0]:
                    new[x, y] = (s, (text, emitted))
        best = new
    top = max(score for score, _ in best.values())
    return max(_joined(text) for score, text in best.values() if score == top).strip()


def _joined(text: tuple) -> str:
    out = []
    while text:
        text, emitted = text
        out.append(emitted)
    return "".join(reversed(out))


class Restorer:
    """Restored words of lower-cased texts, remembered by chunk up to a bound."""

    def __init__(self, model: CharModel, bound: int = 100_000):
        self.model, self.bound, self.known = model, bound, {}

    def words(self, chunk: str) -> tuple[str, ...]:
        found = self.known.get(chunk)
        if found is None:
            if len(self.known) > self.bound:
                self.known.clear()
            found = self._words(chunk)
            if len(chunk) <= 8 * LONGEST:  # longer ones hardly come again
                self.known[chunk] = found
        return found

    def _words(self, chunk: str) -> tuple[str, ...]:
        bare = chunk.strip(EDGES)
        if bare.isalpha() and not RUN.search(bare) and not chunk[0] in "$@!(+|":
            return (bare,)
        kinds = [m[1] for m in re.finditer(r"(.)\1*", bare, re.S)]
        spelt = sum(c.isalpha() or c in STANDS_FOR for c in kinds)
        if not any(c.isalpha() for c in kinds) or spelt * 2 < len(kinds):
            return (bare,) if bare else ()
        hidden = (chunk if chunk[0] in "$@!(+|" and (len(chunk) < 2 or chunk[1].isalpha()) else bare).rstrip(EDGES.replace("!", "").replace("$", "") if bare != chunk.rstrip(EDGES) else EDGES)
        read = [w.strip(EDGES) for w in decode(hidden or bare, self.model).split()]
        pieces = SEPARATORS.split(bare) if len(chunk) > LONGEST else []
        if len(pieces) > 1:
            read += [w for piece in pieces if len(piece) > 2 for w in self.words(piece)]
        return tuple(dict.fromkeys(w for w in read if w))

    def text(self, text: str | None) -> set[str]:
        """Distinct restored words of a text; runs of single characters also as the words they spell."""
        low = (text or "").lower()
        out: set[str] = set()
        for chunk in set(low.split()):
            out.update(self.words(chunk))
        for m in SINGLES.finditer(low):
            out.update(w for w in decode(m[0].replace("\t", " "), self.model).split() if len(w) > 2)
        return out


def beginnings(word: str) -> list[str]:
    """A word's features: itself and its first four, five, six and seven characters."""
    return [word, *(f"{word[:n]}~" for n in (4, 5, 6, 7) if len(word) >= n)]


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` training rows: doc_id, text, toxic."""
    use = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
    use = use.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).dropDuplicates(["doc_id"])
    # a bounded sample; with the share it keeps known, no sort is needed
    total = use.count()
    if total > most:
        share = int(2**31 * min(1.0, 1.2 * most / total))
        use = use.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < share).orderBy(F.xxhash64("doc_id")).limit(most)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(use), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> tuple[np.ndarray, dict[str, float], float]:
    """(trigram counts, weight of each feature, intercept)."""
    counts = trigram_counts(docs)
    model = CharModel(counts)
    from .common import materialise

    train = materialise(_labelled(docs, labels, most), "train")

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, seen = Restorer(model), (Counter(), Counter())
        n = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n[toxic] += 1
                seen[toxic].update({f for w in restore.text(text) for f in beginnings(w)})
        keys = list(seen[1])  # what no toxic text has cannot speak for toxicity
        yield pa.RecordBatch.from_arrays([pa.array(["", *keys], pa.string()), pa.array([n[0], *(seen[0][k] for k in keys)], pa.int64()), pa.array([n[1], *(seen[1][k] for k in keys)], pa.int64())], ["f", "clean", "toxic"])

    found = train.select("text", "toxic").mapInArrow(tidy(tally), "f string, clean bigint, toxic bigint").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = materialise(found, "features")
    size = found.filter("f = ''").first()
    clean, toxic = (size["clean"], size["toxic"]) if size else (0, 0)
    if not clean or not toxic:
        share = 0.5 if not clean + toxic else toxic / (clean + toxic)
        return counts, {}, math.log((share + 1e-6) / (1 - share + 1e-6))
    least = max(3, toxic // 400)
    p1, p0 = (F.col("toxic") + 0.5) / (toxic + 1), (F.col("clean") + 0.5) / (clean + 1)
    ratio = F.col("toxic") * F.log(p1 / p0) + (toxic - F.col("toxic")) * F.log((1 - p1) / (1 - p0))
    chosen = [r["f"] for r in found.filter((F.col("f") != "") & (F.col("toxic") >= least) & (p1 > 3 * p0)).orderBy(F.desc(ratio), "f").collect()]  # of at most FIT_DOCS texts
    index = {f: i for i, f in enumerate(chosen)}

    def present(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model)
        for batch in batches:
            rows = [sorted({index[f] for w in restore.text(t) for f in beginnings(w) if f in index}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "on"])

    rows = train.select("text", "toxic").mapInArrow(tidy(present), "toxic int, on array<int>").collect()  # at most FIT_DOCS short lists
    y = np.array([r["toxic"] for r in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(r["on"]) for r in rows])
    on = np.array([i for r in rows for i in r["on"]], np.int64)
    w, b = _logistic(at, on, y, len(chosen))
    return counts, {f: float(x) for f, x in zip(chosen, w)}, b


def _logistic(at: np.ndarray, on: np.ndarray, y: np.ndarray, size: int, rounds: int = 400, decay: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights (none negative) and intercept of a logistic model with L2 decay, by accelerated gradient steps."""
    w, v, b, step = np.zeros(size), np.zeros(size), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), 0.0
    row = np.bincount(at, minlength=len(y)) + 1
    rate = 4.0 / (np.bincount(on, row[at], minlength=size) + decay)  # bound of the curvature, feature by feature
    rate_b = 4.0 / row.sum()
    for k in range(rounds):
        z = b + np.bincount(at, v[on], minlength=len(y))
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        new = np.maximum(0, v - rate * (np.bincount(on, g[at], minlength=size) + decay * v * 0.1))
        b -= rate_b * g.sum()
        v, w = new + (k / (k + 3)) * (new - w), new
    return w, float(b)


class Scorer:
    """Score of whole texts by a fitted model; what it remembers is bounded."""

    def __init__(self, counts: np.ndarray, weights: dict[str, float], intercept: float):
        self.restore, self.weights, self.intercept, self.hits = Restorer(CharModel(counts)), weights, intercept, {}

    def __call__(self, text: str | None) -> float:
        on: set[str] = set()
        for w in self.restore.text(text):
            found = self.hits.get(w)
            if found is None:
                if len(self.hits) > 100_000:
                    self.hits.clear()
                found = self.hits[w] = tuple(f for f in beginnings(w) if f in self.weights)
            on.update(found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + sum(self.weights[f] for f in sorted(on))))))


def score(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    model = fit(docs, labels, most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(*model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id bigint, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def restored(docs: DataFrame) -> DataFrame:
    """doc_id, restored of every row of docs: its distinct restored words in order of the alphabet, parted by spaces."""
    counts = trigram_counts(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(CharModel(counts))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(sorted(restore.text(t.as_py()))) for t in batch.column(1)], pa.string())], ["doc_id", "restored"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id bigint, restored string")


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> DataFrame:
    """The rows of docs not predicted toxic, all columns. Every row is judged by its own text, whatever its doc_id."""
    model, text = fit(docs, labels, most), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(*model)
        for batch in batches:
            yield batch.filter(pa.array([of(t.as_py()) < 0.5 for t in batch.column(text)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
