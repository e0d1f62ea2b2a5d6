"""N-gram Jaccard join (operator 3): blocked sparse matrix product of documents by n-grams.

1. Every text becomes its set of distinct shingles (64-bit hashes). Equal sets form a class
   whose smallest doc_id represents it; only representatives go on.
2. Blocking. Two sets of at least t similarity must share one of each other's
   ``n - ceil(t n) + 1`` first shingles in any one global order; ours is by document frequency,
   so only shared rare shingles count. Frequencies are exact: shingles travel in packed byte
   strings to the task of their hash range (6 bytes and a 2-byte document index each) and only
   those that two documents share come back to their documents. Very common shingles, found by
   a first pass, are held back, stand last in the order and never travel.
3. Representatives that share such a shingle form candidate classes (components). A class is
   dealt into bands of size by factor 1/t, of which only equal and neighbouring ones can
   link, and each band into blocks of a bounded number of shingles.
4. For each pair of blocks one task multiplies the two sparse incidence blocks, accumulating
   overlap counts over columns, discards pairs below the overlap that both sizes demand, and
   returns the links that join what was not yet joined there (a spanning forest).
5. Components over these links give each document the smallest doc_id reachable.

Defined cases: null or empty text, or only white space: the empty set, linked with nothing;
fewer words than a shingle: the whole sequence as one; repeated rows and ties are equal sets;
null doc_id: left out of all links, its component is null; rows that share a doc_id are told apart by
their sets, and ``keep_one`` keeps those of the smallest doc_id of a component; very long texts are
read whole; other columns are ignored, but kept by ``keep_one``; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import connected_components, keep_ids, materialise, mix64, spare, tidy
from .words import Words, lots

#: Shingles that a task gathers before it sends them off; documents likewise (their index has 16 bits).
FLUSH_SHINGLES, FLUSH_DOCS = 1_500_000, 60_000
#: Share of a flush's documents from which a shingle may be very common, and how many such are kept.
COMMON_SHARE, COMMON_MOST = 0.01, 65_536
#: Shingles and sets in one block of the product.
BLOCK_SHINGLES, BLOCK_SETS = 600_000, 2_000


def prefix_length(n: int, t: Fraction) -> int:
    return n - math.ceil(t * n) + 1


def _as_ratio(similarity: float | str | Fraction) -> Fraction:
    return Fraction(str(similarity))


def sets_of(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; fewer words than size: the whole sequence as one; none: empty."""
    for _, _, words in lots(texts):
        long, short = _hashes(words, size), {}
        for i in np.flatnonzero((np.diff(words.ends, prepend=0) < size) & (np.diff(words.ends, prepend=0) > 0)).tolist():
            h = words.hash[words.of(i)]
            out = np.full(1, len(h), np.uint64)
            with np.errstate(over="ignore"):
                for x in h:
                    out = mix64(out * _STEP + x)
            short[i] = out
        begin = 0
        for i, end in enumerate(words.ends.tolist()):
            yield short[i] if i in short else np.unique(long[begin : max(begin, end - size + 1)])
            begin = end


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hashes(words: Words, size: int) -> np.ndarray:
    """Hash of the shingle that begins at each word, over the ends of texts too."""
    h = words.hash
    n = max(0, len(h) - size + 1)
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mix64(out * _STEP + h[i : i + n])
    return out


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """kind 0: doc_id, n, digest of every document's set; kind 1: shingle (as doc_id), n documents of common ones."""
    fields = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, docs_held = [], 0, 0

        def common() -> pa.RecordBatch:
            kinds, n = np.unique(np.concatenate(held), return_counts=True)
            big = n >= max(8, COMMON_SHARE * docs_held)
            k = int(big.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(kinds[big].view(np.int64)), pa.array(n[big].astype(np.int64)), pa.nulls(k, pa.binary())], schema=fields)

        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for doc, s in zip(ids, sets_of(batch.column(1), size)):
                out.append((0, doc, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None))
                held.append(s)
                count, docs_held = count + len(s), docs_held + 1
                if count >= FLUSH_SHINGLES:
                    yield common()
                    held, count, docs_held = [], 0, 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), fields)], schema=fields)
        if count:
            yield common()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(run), "kind int, doc_id bigint, n bigint, digest binary")


def _send(docs: DataFrame, size: int, parts: int, common: np.ndarray, t: Fraction) -> DataFrame:
    """Packed rows: (to, flush, docs, shingles, extra). One row of a flush is its note: ids, sizes, held-back shingles."""
    fields = pa.schema([("to", pa.int32()), ("flush", pa.string()), ("docs", pa.binary()), ("shingles", pa.binary()), ("extra", pa.binary())])
    num, den = t.numerator, t.denominator

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, count, k = [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal k
            name = f"{TaskContext.get().partitionId()}-{k}"
            k += 1
            n = np.array([len(s) for s in sets], np.int64)
            flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), n)
            held = np.isin(flat, common)
            seldom = np.bincount(doc[~held], minlength=len(sets))
            need = n - -(-n * num // den) + 1 - seldom  # held-back shingles that a prefix still takes
            extra = []
            if held.any():
                hf, hd = flat[held], doc[held]  # ascending within a document
                place = np.arange(len(hd)) - np.searchsorted(hd, hd)
                take = place < need[hd]
                extra = [hd[take].tobytes(), hf[take].tobytes()]
                flat, doc = flat[~held], doc[~held]
            note = b"".join([np.array([len(sets), len(extra[0]) // 2 if extra else 0], np.int64).tobytes(), n.tobytes(), seldom.astype(np.int64).tobytes(), *extra])
            to = ((flat >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            flat, doc, to = flat[order], doc[order], to[order]
            cuts = np.flatnonzero(np.diff(to)) + 1
            begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(to)]])
            rows = [(TaskContext.get().partitionId() % parts, name, np.array(ids, np.int64).tobytes(), note, b"note")]
            low = np.ascontiguousarray(flat).view(np.uint8).reshape(-1, 8)[:, :6]  # the top bits are those of ``to``
            for b, e in zip(begin, end) if len(to) else []:
                rows.append((int(to[b]), name, doc[b:e].tobytes(), low[b:e].tobytes(), None))
            for lo in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[lo : lo + 500]), fields)], schema=fields)

        for batch in batches:
            for doc, s in zip(batch.column(0).to_pylist(), sets_of(batch.column(1), size)):
                if not len(s):
                    continue
                ids.append(doc)
                sets.append(s)
                count += len(s)
                if count >= FLUSH_SHINGLES or len(ids) >= FLUSH_DOCS:
                    yield from flush()
                    ids, sets, count = [], [], 0
        if ids:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "to int, flush string, docs binary, shingles binary, extra binary")


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """In the task of a hash range: what two or more documents share, back to each flush with its document frequency."""
    own = group["extra"].notna()
    notes = group[own].assign(extra=None)[["flush", "docs", "shingles", "extra"]]
    group = group[~own]
    if not len(group):
        return notes
    sizes = [len(d) // 2 for d in group["docs"]]
    low = np.zeros((sum(sizes), 8), np.uint8)
    low[:, :6] = np.frombuffer(b"".join(group["shingles"]), np.uint8).reshape(-1, 6)
    low[:, 6:] = np.frombuffer(np.int32(group["to"].iloc[0]).tobytes(), np.uint8)[:2]
    key = low.reshape(-1).view(np.uint64)
    docs = np.frombuffer(b"".join(group["docs"]), np.uint16)
    _, place, n = np.unique(key, return_inverse=True, return_counts=True)
    df = n[place].astype(np.uint32)
    out, at = [], 0
    for name, k in zip(group["flush"], sizes):
        s = slice(at, at + k)
        many = df[s] > 1
        if many.any():
            out.append((name, docs[s][many].tobytes(), key[s][many].tobytes(), df[s][many].tobytes()))
        at += k
    return pd.concat([notes, pd.DataFrame(out, columns=["flush", "docs", "shingles", "extra"])])


def _prefixes(t: Fraction):
    num, den = t.numerator, t.denominator

    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Of one flush: the shared shingles in each document's prefix."""
        empty = pd.DataFrame({"rep": np.zeros(0, np.int64), "shingle": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        own = group["extra"].isna()
        note = group[own]
        if not len(note):
            return empty
        ids, raw = np.frombuffer(note["docs"].iloc[0], np.int64), note["shingles"].iloc[0]
        m, h = np.frombuffer(raw, np.int64, 2)
        n, seldom = np.frombuffer(raw, np.int64, m, 16), np.frombuffer(raw, np.int64, m, 16 + 8 * m)
        hd = np.frombuffer(raw, np.uint16, h, 16 + 16 * m)
        hs = np.frombuffer(raw, np.uint64, h, 16 + 16 * m + 2 * h)
        back = group[~own]
        docs = np.frombuffer(b"".join(back["docs"]), np.uint16)
        key = np.frombuffer(b"".join(back["shingles"]), np.uint64)
        df = np.frombuffer(b"".join(back["extra"]), np.uint32)
        room = n - -(-n * num // den) + 1
        left = room - (seldom - np.bincount(docs, minlength=m))  # after shingles that no other document has
        order = np.lexsort((key, df, docs))
        docs, key = docs[order], key[order]
        place = np.arange(len(docs)) - np.searchsorted(docs, docs)
        ok = place < left[docs]
        docs, key = np.concatenate([docs[ok], hd]).astype(np.int64), np.concatenate([key[ok], hs])
        return pd.DataFrame({"rep": ids[docs], "shingle": key.view(np.int64), "n": n[docs]})

    return run


def candidates(reps: DataFrame, size: int, t: Fraction, common: np.ndarray, shingles: int) -> DataFrame:
    """rep, shingle, n: shingles in prefixes that other prefixes may hold too."""
    spark = reps.sparkSession
    parts = int(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), shingles // 2_000_000))
    sent = _send(reps, size, parts, common, t)
    # notes pass through the tasks of the hash ranges, so that one read of the texts and one shuffle serve both
    back = sent.groupBy("to").applyInPandas(spare(_shared), "flush string, docs binary, shingles binary, extra binary")
    out = back.groupBy("flush").applyInPandas(spare(_prefixes(t)), "rep bigint, shingle bigint, n bigint")
    return materialise(out, "prefixes")


def _block_sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, s.tobytes()) for i, s in zip(batch.column(0).to_pylist(), sets_of(batch.column(1), size))]
            for lo in range(0, len(rows), 200):
                part = rows[lo : lo + 200]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary())], ["rep", "members"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "rep bigint, members binary")


def overlap(left: list[np.ndarray], right: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Counts of common members of each left with each right set: a sparse product, accumulated over blocks of columns.

    Columns that only one row has cannot count and are left out; rows wait as index lists, and
    each block of columns is filled densely.
    """
    flat = np.concatenate([*left, *right])
    kinds, place, n = np.unique(flat, return_inverse=True, return_counts=True)
    new = np.cumsum(n > 1) - 1
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    keep = n[place] > 1
    row, col = row[keep], new[place[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(new[-1]) + 1 if len(new) else 0, columns):
        s = slice(*np.searchsorted(col, [lo, lo + columns]))
        dense = np.zeros((len(left) + len(right), columns), np.float32)
        dense[row[s], col[s] - lo] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def _product(t: Fraction):
    num, den = t.numerator, t.denominator

    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Links between two blocks (or within one) that join what is not joined yet."""
        group = group.sort_values("rep")
        one, two = group[group["side"] != 1], group[group["side"] != 0]
        left, right = ([np.frombuffer(x, np.uint64) for x in part["members"]] for part in (one, two))
        a, b = [], []
        if left and right:
            ids, jds = one["rep"].to_numpy(), two["rep"].to_numpy()
            n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
            root = {x: x for x in (*ids, *jds)}

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for lo in range(0, len(left), 512):
                both = overlap(left[lo : lo + 512], right).astype(np.int64)
                # den * both >= num * (n + m - both): the size-derived bound on the overlap
                link = (den + num) * both >= num * (n[lo : lo + 512, None] + m[None, :])
                for i, j in zip(*np.nonzero(link)):
                    x, y = find(ids[lo + i]), find(jds[j])
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        a.append(ids[lo + i])
                        b.append(jds[j])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def band_of(n, t: Fraction):
    """Size band: neighbours hold every size that can link."""
    return F.floor(F.log(n.cast("double")) / math.log(float(1 / t)) + 1e-9).cast("int")


def verified_links(reps: DataFrame, prefixes: DataFrame, size: int, t: Fraction) -> DataFrame:
    """a, b: links that span every component, each verified exactly."""
    by = prefixes.groupBy("shingle").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("shingle", "low")
    edges = prefixes.join(by, "shingle").select(F.col("rep").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
    classes = connected_components(edges, "candidates").select(F.col("node").alias("rep"), F.col("component").alias("class"))
    sizes = prefixes.select("rep", "n").distinct()
    member = classes.join(sizes, "rep").withColumn("band", band_of(F.col("n"), t))
    member = materialise(member, "members")
    spread = member.groupBy("class", "band").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("blocks"))
    above = spread.select("class", (F.col("band") - 1).alias("band"), F.col("blocks").alias("blocks_above"))
    below = spread.select("class", (F.col("band") + 1).alias("band"), F.col("blocks").alias("blocks_below"))
    m = member.join(spread, ["class", "band"]).join(above, ["class", "band"], "left").join(below, ["class", "band"], "left")
    m = m.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    none = F.array().cast("array<struct<band:int,block:int,other:int,step:int,side:int>>")

    def key(band, block, other, step, side):
        return F.struct(band.cast("int").alias("band"), block.cast("int").alias("block"), other.cast("int").alias("other"), F.lit(step).alias("step"), side.cast("int").alias("side"))

    band, block = F.col("band"), F.col("block")
    own = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: key(band, F.least(block, j), F.greatest(block, j), 0, F.when(j == block, 2).when(block < j, 0).otherwise(1)))
    up = F.when(F.col("blocks_above").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("blocks_above") - 1), lambda j: key(band, block, j, 1, F.lit(0)))).otherwise(none)
    down = F.when(F.col("blocks_below").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("blocks_below") - 1), lambda j: key(band - 1, j, block, 1, F.lit(1)))).otherwise(none)
    keyed = m.select("rep", "class", F.explode(F.concat(own, up, down)).alias("k")).select("rep", "class", "k.*")
    sets = _block_sets(keep_ids(reps, member.select(F.col("rep").alias("doc_id"))), size)
    return keyed.join(sets, "rep").groupBy("class", "band", "block", "other", "step").applyInPandas(_product(t), "a bigint, b bigint")


def link_documents(docs: DataFrame, size: int = 5, similarity: float | str | Fraction = "0.8") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    t = _as_ratio(similarity)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    seen = materialise(shingle_sets(docs, size), "sets")
    sets = seen.filter("kind = 0")
    top = seen.filter("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "doc_id").limit(COMMON_MOST).collect()
    common = np.sort(np.array([r["doc_id"] for r in top], np.int64).view(np.uint64))
    by_set = sets.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    by_set = materialise(by_set, "reps")
    reps = keep_ids(docs.filter("doc_id is not null"), by_set.select(F.col("rep").alias("doc_id"))).dropDuplicates(["doc_id"]) if _repeated(sets) else keep_ids(docs, by_set.select(F.col("rep").alias("doc_id")))
    shingles = by_set.agg(F.sum("n")).first()[0] or 0
    prefixes = candidates(reps, size, t, common, int(shingles))
    links = materialise(verified_links(reps, prefixes, size, t), "links")
    parts = connected_components(links, "linked").select(F.col("node").alias("rep"), "component")
    rep_of = by_set.select("digest", "rep").join(parts, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    # empty sets, of which there may be very many, have no digest and join nothing
    none = sets.filter("digest is null").withColumn("component", F.lit(None).cast("bigint"))
    out = sets.filter("digest is not null").join(rep_of, "digest", "left").unionByName(none)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _repeated(sets: DataFrame) -> bool:
    return not sets.groupBy("doc_id").count().filter("count > 1").isEmpty()


def keep_one(docs: DataFrame, size: int = 5, similarity: float | str | Fraction = "0.8") -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, all columns; rows without doc_id stay."""
    found = link_documents(docs, size, similarity)
    stay = found.filter("doc_id = component_id").select("doc_id").distinct()
    kept = keep_ids(docs, stay)
    return kept if docs.filter("doc_id is null").isEmpty() else kept.unionByName(docs.filter("doc_id is null"))
