"""Language-model scoring with a gated recurrent network (operator 9).

Tokens are words and one end. Their probability is factored by class, both factors from the state of
a gated recurrent unit over the tokens so far: P(class | state), a softmax over ``CLASSES``, times
P(word | class, state), a softmax over the words of the class. The ``VOCABULARY`` most frequent words
are put into classes of ``MEMBERS`` by rank and have embeddings of their own; the end is a class. All
other words, of which a corpus has no bounded number, fall into classes by their ending, by which the
network sees them, and whose second factor is the word's smoothed share of the class's training
count. An unseen word takes its class's share for the unseen, so probabilities sum to one over known
words and one unknown a class. State runs on from window to window over a whole document.

Counts cover all training documents: every task counts its words, hash and class only, and the
counts are summed by hash. Scoring looks the ``TOP`` most frequent words up locally, whatever
the size of the corpus; all other words travel, packed by flush, to the task of their hash
range, which holds their counts and returns sums by document. The network's weights are fitted
by truncated backpropagation in numpy on all training documents: it starts from ``EPOCHS`` epochs
over about ``FIT_TOKENS`` tokens (whole documents, smallest hash first), then every task goes on
from there over all documents of its partition, lot by lot, and the tasks' weights are averaged
by tokens.

Defined cases: a null text is empty and has one token, the end; a null doc_id is not held out;
repeated rows are scored each and counted each; other columns are ignored; ties of frequency go by
hash; without training tokens every word is unseen and the network is uniform; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import materialise
from .words import PAD, Table, Words, hash_word, lots

HIDDEN, OPEN, GROUPS, MEMBERS = 24, 31, 32, 64
VOCABULARY, CLASSES = GROUPS * MEMBERS, OPEN + GROUPS + 1
#: Numbers of tokens: words of the vocabulary, classes by ending, the end (which is also what a document starts from), filling.
MARK, FILL = VOCABULARY + OPEN, VOCABULARY + OPEN + 1
TOP, FIT_TOKENS, EPOCHS, WINDOW, LANES = 65_536, 800_000, 3, 32, 256
LOT_TOKENS, RATE = 400_000, 0.003
FLUSH_TOKENS, FLUSH_DOCS = 1_500_000, 60_000
END_HASH = 0x656E64
PUNCTUATION = b".,;:!?#%*&$|()[]{}\"'-"
LN10 = math.log(10)
#: Class of each token number, and its place among the class's words (-1: decided by the class alone, or by counts).
CLASS_OF = np.concatenate([OPEN + np.arange(VOCABULARY) // MEMBERS, np.arange(OPEN), [CLASSES - 1, 0]])
PLACE_OF = np.concatenate([np.arange(VOCABULARY) % MEMBERS, np.full(OPEN + 2, -1)])
_STOPS = np.zeros(256, bool)
_STOPS[list(PUNCTUATION)] = True


def endings(words: Words, at: np.ndarray) -> np.ndarray:
    """Class by ending of the words there: from the last three bytes but punctuation, and whether that follows."""
    low, begin = words.low, words.begin[at]
    end = begin + words.size[at]
    here = np.arange(len(low))
    solid = ~_STOPS[low]
    last = np.maximum.accumulate(np.where(solid, here, -1))
    first = np.minimum.accumulate(np.where(solid, here, len(low))[::-1])[::-1]
    core = np.maximum(last[end - 1] + 1, begin) if len(at) else end
    size = np.clip(core - np.minimum(first[begin], core), 0, 3) if len(at) else end
    eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
    tail = (eight[core - 8] >> np.uint64(40)) >> (8 * (3 - size)).astype(np.uint64)
    tail = np.where(size > 0, tail, np.uint64(0)) * np.uint64(2) + ((core < end) & (size > 0)).astype(np.uint64)
    return ((tail * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(OPEN)).astype(np.int32)


def ending_class(word: bytes) -> int:
    """Class by ending of one word, lower-cased already."""
    return int(endings(Words(pa.array([word.decode()], pa.string())), np.zeros(1, np.int64))[0])


def count_words(docs: DataFrame) -> DataFrame:
    """hash, class, n of all words of docs, and the end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = ends = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, c, n = (np.concatenate(x) for x in zip(*held))
            kinds, first, place = np.unique(h, return_index=True, return_inverse=True)
            return kinds, c[first], np.bincount(place, n).astype(np.int64)

        def emit() -> pa.RecordBatch:
            h, c, n = held[0]
            return pa.RecordBatch.from_arrays([pa.array(np.append(h.view(np.int64), END_HASH)), pa.array(np.append(c, CLASSES - 1).astype(np.int32)), pa.array(np.append(n, ends))], ["hash", "class", "n"])

        for batch in batches:
            for lo, hi, words in lots(batch.column(0)):
                ends += hi - lo
                kinds, first, n = np.unique(words.hash, return_index=True, return_counts=True)
                held.append((kinds, endings(words, first), n))
                size += len(kinds)
                if size > 2_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield emit()
                        held, size, ends = [], 0, 0
        if held:
            held = [merged()]
            yield emit()

    return docs.select("text").mapInArrow(run, "hash bigint, class int, n bigint").groupBy("hash", "class").agg(F.sum("n").alias("n"))


class Adam:
    """Running moments of the gradients."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.first, self.second, self.t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: Callable[[int], float]) -> None:
        self.t += 1
        t, a = self.t, rate(self.t)
        scale, bias = np.float32(a / (1 - 0.9**t)), np.float32(1 / (1 - 0.995**t))
        for k, v in g.items():
            np.clip(v, -0.5, 0.5, out=v)
            one, two = self.first[k], self.second[k]
            one *= np.float32(0.9)
            one += np.float32(0.1) * v
            v *= v
            v *= np.float32(0.005)
            two *= np.float32(0.995)
            two += v
            np.sqrt(two * bias, out=v)
            v += np.float32(1e-6)
            p[k] -= scale * one / v


class Network:
    """A gated recurrent unit over tokens, a softmax over classes and one over each class's words."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {
            "x": r.normal(0, 0.1, (VOCABULARY + OPEN + 1, 3 * HIDDEN)), "u": r.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)), "b": np.zeros(HIDDEN),
            "o": np.zeros((HIDDEN, CLASSES)), "c": np.zeros(CLASSES), "v": np.zeros((GROUPS, HIDDEN, MEMBERS)), "d": np.zeros((GROUPS, MEMBERS)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def start(self, numbers: np.ndarray) -> None:
        """Biases at the shares of classes and words (``numbers``: count of each token number up to the end)."""
        of_class = np.bincount(CLASS_OF[: MARK + 1], numbers, CLASSES) + 0.5
        self.p["c"] = np.log(of_class / of_class.sum()).astype(np.float32)
        words = numbers[:VOCABULARY].reshape(GROUPS, MEMBERS)
        # places that no word has take no probability
        self.p["d"] = np.where(words > 0, np.log(np.maximum(words, 1)), -30.0).astype(np.float32)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        u = h @ self.p["u"]
        zr = x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]
        zr *= np.float32(0.5)
        np.tanh(zr, out=zr)
        zr *= np.float32(0.5)
        zr += np.float32(0.5)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        m = u[:, 2 * HIDDEN :] + self.p["b"]
        n = r * m
        n += x[:, 2 * HIDDEN :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, m, n

    def fit(self, documents: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.006) -> None:
        """Fit from nothing, with a falling rate; few documents are cut into few lanes, so that there are steps enough."""
        if not documents:
            return
        grid, adam = self._lanes(documents, 100), Adam(self.p)
        rounds = epochs * max(1, (len(grid) - 1) // WINDOW)
        for _ in range(epochs):
            self._pass(grid, adam, lambda t: rate * (1 - 0.95 * t / rounds) if t < rounds else rate * 0.05)

    def go_on(self, documents: list[np.ndarray], adam: Adam) -> None:
        """One pass over a lot of further documents."""
        self._pass(self._lanes(documents), adam, lambda t: RATE)

    def _lanes(self, documents: list[np.ndarray], windows: int = 4) -> np.ndarray:
        """Joined documents (each ends in the mark, from which the next one starts), cut into lanes, the last one filled up."""
        stream = np.concatenate([[MARK], *documents]).astype(np.int64)
        lanes = max(1, min(LANES, len(stream) // (windows * WINDOW)))
        length = -(-(len(stream) - 1) // lanes)
        stream = np.append(stream, np.full(lanes * length + 1 - len(stream), FILL))
        # a lane's last token is the next one's first
        return np.concatenate([stream[:-1].reshape(lanes, length), stream[length::length][:, None]], 1).T

    def _pass(self, grid: np.ndarray, adam: Adam, rate: Callable[[int], float]) -> None:
        """Truncated backpropagation over all windows, state carried from window to window."""
        h = np.zeros((grid.shape[1], HIDDEN), np.float32)
        for lo in range(0, len(grid) - 1, WINDOW):
            h, g = self._window(grid, range(lo, min(lo + WINDOW, len(grid) - 1)), h)
            adam.step(self.p, g, rate)

    def _window(self, grid: np.ndarray, steps: range, h: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        kept = []
        for s in steps:
            seen = np.minimum(grid[s], MARK)
            h = np.where((seen == MARK)[:, None], np.float32(0), h)  # a new document starts from nothing
            new, *gates = self.step(self.p["x"].take(seen, 0), h)
            kept.append((seen, h, new, *gates))
            h = new
        hs = np.concatenate([k[2] for k in kept])
        target = grid[steps[0] + 1 : steps[-1] + 2].reshape(-1)
        real = target != FILL  # filling is not predicted
        weight = real.astype(np.float32) / np.float32(max(1, real.sum()))
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        lanes, later = len(h), np.zeros_like(h)
        back, ones = np.empty_like(hs), np.ones(CLASSES, np.float32)
        of_class, place = CLASS_OF[target], PLACE_OF[target]
        out_t = np.ascontiguousarray(self.p["o"].T)
        for lo in range(0, len(hs), 8 * lanes):  # pieces that stay in the cache
            part, w, want = hs[lo : lo + 8 * lanes], weight[lo : lo + 8 * lanes], of_class[lo : lo + 8 * lanes]
            d = part @ self.p["o"]
            d += self.p["c"]
            d -= d.max(1, keepdims=True)
            np.exp(d, out=d)
            d *= (w / (d @ ones))[:, None]
            d[np.arange(len(d)), want] -= w
            g["o"] += part.T @ d
            g["c"] += d.sum(0)
            back[lo : lo + 8 * lanes] = d @ out_t
        inner = np.ones(MEMBERS, np.float32)
        for k, at in _by_group(of_class, place):
            part, w = hs[at], weight[at]
            d = part @ self.p["v"][k]
            d += self.p["d"][k]
            d -= d.max(1, keepdims=True)
            np.exp(d, out=d)
            d *= (w / (d @ inner))[:, None]
            d[np.arange(len(at)), place[at]] -= w
            g["v"][k] = part.T @ d
            g["d"][k] = d.sum(0)
            back[at] += d @ self.p["v"][k].T
        to_gates, to_new = np.ascontiguousarray(self.p["u"][:, : 2 * HIDDEN].T), np.ascontiguousarray(self.p["u"][:, 2 * HIDDEN :].T)
        dx, dm = np.empty((len(kept), lanes, 3 * HIDDEN), np.float32), np.empty((len(kept), lanes, HIDDEN), np.float32)
        for i in range(len(kept) - 1, -1, -1):
            seen, before, _, z, r, m, n = kept[i]
            dh = back[i * lanes : (i + 1) * lanes] + later
            hz = dh * z
            dn = dh - hz
            dn *= 1 - n * n
            np.multiply(dn, r, out=dm[i])
            dx[i, :, 2 * HIDDEN :] = dn
            dx[i, :, :HIDDEN] = hz * (before - n) * (1 - z)
            dx[i, :, HIDDEN : 2 * HIDDEN] = dm[i] * m * (1 - r)
            later = hz
            later += dx[i, :, : 2 * HIDDEN] @ to_gates
            later += dm[i] @ to_new
            later[seen == MARK] = 0
        dx, dm = dx.reshape(-1, 3 * HIDDEN), dm.reshape(-1, HIDDEN)
        before, seen = np.concatenate([k[1] for k in kept]), np.concatenate([k[0] for k in kept])
        g["u"] = np.concatenate([before.T @ dx[:, : 2 * HIDDEN], before.T @ dm], 1)
        g["b"] = dm.sum(0)
        order = np.argsort(seen.astype(np.uint16), kind="stable")
        seen = seen[order]
        starts = np.flatnonzero(np.append(True, seen[1:] != seen[:-1]))
        g["x"][seen[starts]] = np.add.reduceat(dx[order], starts)
        return h, g

    def logs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probability (of class, and of word in class where there is one) of each target (-1: 0) after its state."""
        real = np.where(target < 0, MARK, target)
        of_class, place = CLASS_OF[real], PLACE_OF[real]
        a = h @ self.p["o"]
        a += self.p["c"]
        a -= a.max(1, keepdims=True)
        out = a[np.arange(len(a)), of_class]
        np.exp(a, out=a)
        out -= np.log(a @ np.ones(CLASSES, np.float32))
        inner = np.ones(MEMBERS, np.float32)
        for k, at in _by_group(of_class, place):
            a = h[at] @ self.p["v"][k]
            a += self.p["d"][k]
            a -= a.max(1, keepdims=True)
            own = a[np.arange(len(at)), place[at]]
            np.exp(a, out=a)
            out[at] += own - np.log(a @ inner)
        return np.where(target < 0, 0, out)

    def score(self, documents: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence of tokens, whole, state carried throughout."""
        out = np.zeros(len(documents))
        order = np.argsort([-len(d) for d in documents], kind="stable")
        for lo in range(0, len(order), 512):
            lot = order[lo : lo + 512]
            sizes = np.array([len(documents[i]) for i in lot])
            total = np.zeros(len(lot))
            h, seen = np.zeros((len(lot), HIDDEN), np.float32), np.full(len(lot), MARK)
            for begin in range(0, int(sizes.max()), WINDOW):
                live = int((sizes > begin).sum())  # longest first: a prefix of the lanes
                span = min(WINDOW, int(sizes[0]) - begin)
                grid = np.full((live, span), -1, np.int64)
                for k in range(live):
                    d = documents[lot[k]][begin : begin + span]
                    grid[k, : len(d)] = d
                h, seen = h[:live], seen[:live]
                states = np.empty((span, live, HIDDEN), np.float32)
                for s in range(span):
                    h = self.step(self.p["x"].take(seen, 0), h)[0]
                    states[s] = h
                    seen = grid[:, s]  # -1 (past the end) reads a row whose result is not used
                for a in range(0, span, 16):
                    part = states[a : a + 16].reshape(-1, HIDDEN)
                    logs = self.logs(part, grid[:, a : a + 16].T.reshape(-1))
                    total[:live] += logs.reshape(-1, live).sum(0, dtype=np.float64)
            out[lot] = total / LN10
        return out


def _by_group(of_class: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group of words, where its words are wanted), group by group."""
    at = np.flatnonzero(place >= 0)
    group = (of_class[at] - OPEN).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(GROUPS + 1))
    for k in range(GROUPS):
        if cuts[k + 1] > cuts[k]:
            yield k, at[order[cuts[k] : cuts[k + 1]]]


class Known:
    """The top words by falling count: hashes, counts; the first of them are the network's vocabulary."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts

    def open(self) -> None:
        if not hasattr(self, "table"):
            self.table = Table(self.keys)
            self.log = np.append(np.log10(self.counts + 0.5), np.nan)  # -1: none

    def __getstate__(self):
        return {"keys": self.keys, "counts": self.counts}

    def tokens(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(token number, log10(count + 0.5) or nan) of every word."""
        self.open()
        found = self.table.find(words.hash)
        out = found.astype(np.int64)
        rest = np.flatnonzero((found < 0) | (found >= VOCABULARY))
        out[rest] = VOCABULARY + endings(words, rest)
        return out, self.log[found]


def documents_of(texts: pa.Array, known: Known) -> Iterator[tuple[int, int, Words, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Lot by lot: first and last text, words, tokens of each text with the end, tokens without ends, logs."""
    for lo, hi, words in lots(texts):
        number, log = known.tokens(words)
        every = np.insert(number, words.ends, MARK).astype(np.uint16)
        yield lo, hi, words, np.split(every, (words.ends + np.arange(1, len(words) + 1))[:-1]), number, log


class Model:
    """What scoring needs: totals, the top words, class shares and the network. Its size does not follow the corpus."""

    def __init__(self, n: int, v: int, known: Known, shares: np.ndarray, ends: int, network: Network):
        self.n, self.v, self.known, self.shares, self.ends, self.network = n, v, known, shares, ends, network


def train(docs: DataFrame, fit_tokens: int = FIT_TOKENS) -> tuple[Model, DataFrame]:
    """(model, counts) from training rows (doc_id, text)."""
    counts = materialise(count_words(docs), "counts")
    whole = counts.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    ends_row = counts.filter((F.col("hash") == END_HASH) & (F.col("class") == CLASSES - 1)).first()
    words = counts.filter(F.col("class") < CLASSES - 1)
    rows = words.orderBy(F.desc("n"), "hash").limit(TOP).collect()
    known = Known(np.array([r["hash"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64))
    # counts by ending of the words that are not in the vocabulary
    shares = np.zeros(OPEN)
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        shares[r["class"]] = r["n"] + 0.5 * r["v"]
    for r in rows[:VOCABULARY]:
        shares[r["class"]] -= r["n"] + 0.5
    ends = ends_row["n"] if ends_row else 0
    numbers = np.zeros(MARK + 1)
    numbers[: min(VOCABULARY, len(rows))] = known.counts[:VOCABULARY]
    numbers[VOCABULARY:MARK], numbers[MARK] = np.maximum(0, shares), ends
    network = Network()
    total = whole["n"] or 0
    if total:
        network.start(numbers)
        share = min(1.0, 1.1 * fit_tokens / total)
        picked = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) <= int(share * 2**31))
        network.fit(_fit_documents(picked, known, fit_tokens))
        network.p = _fit_all(docs, known, network, total)
    return Model(total, whole["v"] or 0, known, np.log10(shares + 0.5), ends, network), counts


def _fit_documents(picked: DataFrame, known: Known, most: int) -> list[np.ndarray]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, documents, _, _ in documents_of(batch.column(1), known):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([d.tobytes() for d in documents], pa.binary())], ["key", "tokens"])

    rows = picked.select(F.xxhash64("doc_id").alias("key"), "text").mapInArrow(run, "key bigint, tokens binary")
    # two bytes a token; as many documents as the bound takes
    found, size = [], 0
    for r in sorted(rows.collect(), key=lambda r: (r["key"] % 2**31, r["tokens"])):
        found.append(np.frombuffer(r["tokens"], np.uint16))
        size += len(found[-1])
        if size >= most:
            break
    return found


def _fit_all(docs: DataFrame, known: Known, network: Network, total: int) -> dict[str, np.ndarray]:
    """Weights after every task went on from network over all its documents, averaged by tokens. A row a weight, however many tasks."""
    shared = docs.sparkSession.sparkContext.broadcast((known, network.p))
    cuts = np.cumsum([v.size for v in network.p.values()])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, start = shared.value
        net = Network()
        net.p = {k: v.copy() for k, v in start.items()}
        adam, lot, held, seen = Adam(net.p), [], 0, 0
        for batch in batches:
            for *_, documents, number, _ in documents_of(batch.column(0), top):
                lot += documents
                held += len(number) + len(documents)
                if held >= LOT_TOKENS:
                    net.go_on(lot, adam)
                    lot, held, seen = [], 0, seen + held
        if lot:
            net.go_on(lot, adam)
            seen += held
        if seen:
            flat = np.concatenate([v.reshape(-1) for v in net.p.values()]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(flat), dtype=np.int32)), pa.array(np.append(1.0, flat) * seen)], ["k", "w"])

    rows = docs.select("text").mapInArrow(run, "k int, w double").groupBy("k").agg(F.sum("w").alias("w")).toPandas()
    sums = np.zeros(cuts[-1] + 1)
    sums[rows["k"].to_numpy() + 1] = rows["w"].to_numpy()
    if round(sums[0]) != total:
        raise ValueError(f"the network was fitted on {sums[0]:.0f} of {total} tokens")
    parts = np.split((sums[1:] / total).astype(np.float32), cuts[:-1])
    return {k: part.reshape(v.shape) for (k, v), part in zip(network.p.items(), parts)}


def _send(docs: DataFrame, model: Model, parts: int) -> DataFrame:
    """Rows (to, flush, docs, keys, extra): words to be looked up elsewhere, and each flush's own note."""
    fields = pa.schema([("to", pa.int32()), ("flush", pa.string()), ("docs", pa.binary()), ("keys", pa.binary()), ("extra", pa.binary())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, k = shared.value, 0
        ids: list[int | None] = []
        documents: list[np.ndarray] = []
        notes: list[np.ndarray] = []
        far: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        end_log = math.log10(m.ends + 0.5)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal k
            name = f"{TaskContext.get().partitionId()}-{k}"
            k += 1
            note = np.concatenate(notes)
            note[:, 3] += m.network.score(documents)
            doc, key = (np.concatenate(x) for x in zip(*far))
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(doc) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(doc))).astype(np.uint32)
            doc, key = doc[new].astype(np.uint16), key[new]
            to = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            to, key, doc, times = to[order], key[order], doc[order], times[order]
            cuts = np.flatnonzero(np.diff(to)) + 1
            raw = np.array([-(2**63) if i is None else i for i in ids], np.int64).tobytes()
            rows = [(TaskContext.get().partitionId() % parts, name, raw, note.tobytes(), b"note")]
            if len(to):
                rows += [(int(to[b]), name, doc[b:e].tobytes(), key[b:e].tobytes(), times[b:e].tobytes()) for b, e in zip([0, *cuts], [*cuts, len(to)])]
            for lo in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[lo : lo + 500]), fields)], schema=fields)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, hi, words, texts, number, log in documents_of(batch.column(1), m.known):
                doc = np.repeat(np.arange(hi - lo), np.diff(words.ends, prepend=0))
                here, tail = ~np.isnan(log), number >= VOCABULARY
                own = np.where(here, log, 0)

                def by_text(x: np.ndarray) -> np.ndarray:
                    return np.bincount(doc, x, hi - lo)

                note = np.zeros((hi - lo, 5))
                note[:, 0] = np.diff(words.ends, prepend=0) + 1
                note[:, 1] = by_text(here) + (m.ends > 0)
                note[:, 2] = by_text(own) + end_log
                note[:, 3] = by_text(np.where(tail, own - m.shares[np.where(tail, number - VOCABULARY, 0)], 0))
                far.append((doc[~here] + len(ids), words.hash[~here]))
                notes.append(note)
                ids += names[lo:hi]
                documents += texts
                held += len(number) + hi - lo
                if held >= FLUSH_TOKENS or len(ids) >= FLUSH_DOCS:
                    yield from flush()
                    ids, documents, notes, far, held = [], [], [], [], 0
        if ids:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, "to int, flush string, docs binary, keys binary, extra binary")


def _look_up(sent: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """In the task of a hash range: per flush, each document's sum of log10(count + 0.5) and its known words."""
    keys, n = counts["hash"].to_numpy().view(np.uint64), counts["n"].to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    out = []
    for name, docs, key, extra in zip(sent["flush"], sent["docs"], sent["keys"], sent["extra"]):
        if extra == b"note":
            out.append((name, docs, key, extra))
            continue
        doc, key, times = np.frombuffer(docs, np.uint16), np.frombuffer(key, np.uint64), np.frombuffer(extra, np.uint32)
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        c = np.where(keys[at] == key, n[at], 0) if len(keys) else np.zeros(len(key), np.int64)
        who, place = np.unique(doc, return_inverse=True)
        sums, known = np.bincount(place, times * np.log10(c + 0.5)), np.bincount(place, times * (c > 0))
        out.append((name, who.tobytes(), sums.tobytes(), known.astype(np.int64).tobytes()))
    return pd.DataFrame(out, columns=["flush", "docs", "keys", "extra"])


def score(docs: DataFrame, fold: int = 1, folds: int = 5, fit_tokens: int = FIT_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Rows whose crc32(doc_id as text) modulo ``folds`` is ``fold`` are held out of training.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))
    model, counts = train(docs.filter(~held), fit_tokens)
    spark = docs.sparkSession
    parts = int(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), model.v // 1_000_000))
    sent = _send(docs, model, parts)
    # the top words never travel
    least = int(model.known.counts.min()) if len(model.known.counts) else 0
    rest = counts.filter((F.col("class") < CLASSES - 1) & (F.col("n") <= least))
    rest = rest.select(F.shiftright(F.shiftrightunsigned("hash", 32) * parts, 32).cast("int").alias("to"), "hash", "n")
    back = sent.groupBy("to").cogroup(rest.groupBy("to")).applyInPandas(_look_up, "flush string, docs binary, keys binary, extra binary")
    n, v = model.n, model.v
    per_token = math.log10(n + 0.5 * (v + 1))

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        notes = group[group["extra"] == b"note"]
        if not len(notes):
            raise ValueError("a flush without its note")
        ids = np.frombuffer(notes["docs"].iloc[0], np.int64)
        note = np.frombuffer(notes["keys"].iloc[0], np.float64).reshape(-1, 5).copy()
        for docs_, sums, known in group.loc[group["extra"] != b"note", ["docs", "keys", "extra"]].itertuples(index=False):
            who = np.frombuffer(docs_, np.uint16)
            note[who, 1] += np.frombuffer(known, np.int64)
            note[who, 2] += np.frombuffer(sums, np.float64)
            note[who, 3] += np.frombuffer(sums, np.float64)
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64").astype("Int64"), "n_tokens": note[:, 0].astype(np.int64), "n_known": note[:, 1].astype(np.int64), "base_score": note[:, 2] - note[:, 0] * per_token, "score": note[:, 3]})

    out = back.groupBy("flush").applyInPandas(gather, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    out = out.withColumn("doc_id", F.when(F.col("doc_id") > -(2**63), F.col("doc_id")))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
