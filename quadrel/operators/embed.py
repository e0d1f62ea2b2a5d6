"""Concept embeddings by hashed character n-grams, and exact nearest neighbours."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ship


def hash_vector(text: str | None, dim: int = 384, ngram: int = 3) -> list[float]:
    """Signed, hashed counts of character n-grams, of length 1; of nothing: zeros."""
    vector, s = [0.0] * dim, (text or "").lower()
    if not s:
        return vector
    padded = f"  {s}  "
    for i in range(len(padded) - ngram + 1):
        h = int.from_bytes(hashlib.blake2b(padded[i : i + ngram].encode(), digest_size=8).digest(), "big")
        vector[h % dim] += 1.0 if h >> 63 else -1.0
    norm = math.sqrt(sum(x * x for x in vector))
    return [x / norm for x in vector] if norm else vector


def embed(df: DataFrame, text: str, out: str = "embedding", encode=hash_vector) -> DataFrame:
    """df with a vector of its text column; ``encode`` is any function of a text, called in Arrow batches."""
    ship(df.sparkSession)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(encode)

    return df.withColumn(out, run(F.col(text)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


#: Queries of one pass over the vectors: some 100 MB a worker at 64 numbers a vector.
PASS_QUERIES = 65_536
#: Scores of pairs without a similarity, of undefined numbers (the largest, as in a sort) and of places not taken.
NONE, UNDEFINED, FREE = -3.0, 3.0, -np.inf
#: Beyond the rounding of a matrix product and of ten digits.
MARGIN = 1e-9


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first number to the last: equal pairs give equal sums wherever they stand."""
    out = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for i in range(a.shape[1]):
            out += a[:, i] * b[:, i]
    return out


def _units(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places and unit vectors of the rows that are not null; of a zero vector, or one with a null in it: zeros."""
    column = column.cast(pa.list_(pa.float64()))
    n, at = column.value_lengths().fill_null(-1).to_numpy(), column.offsets.to_numpy()
    missing = np.concatenate(([0], np.cumsum(np.asarray(column.values.is_null()))))
    numbers, found = column.values.fill_null(0.0).to_numpy(), {}
    for size in np.unique(n[n >= 0]).tolist():
        rows = np.flatnonzero(n == size)
        v = numbers[at[rows][:, None] + np.arange(size)]
        v[missing[at[rows + 1]] != missing[at[rows]]] = 0.0
        norm = np.sqrt(_dots(v, v))[:, None]
        with np.errstate(all="ignore"):
            found[size] = rows, np.where(norm == 0, 0.0, v / norm)
    return found


def _rounded(x: np.ndarray) -> np.ndarray:
    """Ten digits, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 1e10 + 0.5), x)


class _Nearest:
    """The k best keys of every query among the vectors offered so far."""

    def __init__(self, keys: list, column: pa.Array, k: int):
        self.keys, self.k, self.units = np.array(keys), k, _units(column)
        self.score = np.full((len(keys), k), FREE)
        self.near: np.ndarray | None = None

    def _keep(self, rows: np.ndarray, score: np.ndarray, keys: np.ndarray) -> None:
        """Add candidates (places of queries, scores, keys)."""
        own, k = np.unique(rows), self.k
        r = np.concatenate((np.repeat(own, k), rows))
        s, x = np.concatenate((self.score[own].ravel(), score)), np.concatenate((self.near[own].ravel(), keys))
        order = np.lexsort((x, -_rounded(s), r))
        r, s, x = r[order], s[order], x[order]
        first = np.searchsorted(r, own)
        take = first[:, None] + np.arange(k)
        self.score[own], self.near[own] = s[take], x[take]

    def offer(self, keys: np.ndarray, column: pa.Array) -> None:
        k = self.k
        if self.near is None:
            self.near = np.full(self.score.shape, keys[0])
        units, every = _units(column), np.arange(len(self.keys))
        for size, (rows, v) in units.items():
            if size not in self.units:
                continue
            # of equal vectors only the k smallest keys can be near
            by_key = np.argsort(keys[rows], kind="stable")
            rows, v = rows[by_key], np.ascontiguousarray(v[by_key])
            bits = v.view(np.dtype((np.void, v.itemsize * size))).ravel() if size else np.zeros(len(v), "i1")
            same = np.unique(bits, return_inverse=True)[1].ravel()
            order = np.argsort(same, kind="stable")
            ordered = same[order]
            keep = np.sort(order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < k])
            rows, v = rows[keep], v[keep]
            places, q = self.units[size]
            for at in range(0, len(places), 512):
                own, mine = places[at : at + 512], q[at : at + 512]
                with np.errstate(all="ignore"):
                    s = mine @ v.T
                s[np.isnan(s)] = UNDEFINED
                least = self.score[own, -1]
                if len(rows) > k and (empty := least == FREE).any():
                    least[empty] = np.partition(s[empty], len(rows) - k, axis=1)[:, len(rows) - k]
                i, j = np.nonzero(s >= (least - MARGIN)[:, None])
                for part in range(0, len(i), 200_000):
                    a, b = i[part : part + 200_000], j[part : part + 200_000]
                    exact = _dots(mine[a], v[b])
                    exact[np.isnan(exact)] = UNDEFINED
                    self._keep(own[a], exact, keys[rows[b]])
        # pairs without a similarity come after all others
        for own in (every if not self.units else np.setdiff1d(every, np.concatenate([p for p, _ in self.units.values()])), *(p for p, _ in self.units.values())):
            open_ = own[self.score[own, -1] <= NONE]
            if not len(open_):
                continue
            size = next((n for n, (p, _) in self.units.items() if len(p) and open_[0] in p), None)
            odd = np.sort(keys[np.setdiff1d(np.arange(len(keys)), units[size][0]) if size in units else np.arange(len(keys))])[:k]
            if len(odd):
                self._keep(np.repeat(open_, len(odd)), np.full(len(open_) * len(odd), NONE), np.tile(odd, len(open_)))

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Queries, keys and similarities, in parts; an undefined number is NaN, none is null."""
        for at in range(0, len(self.keys) if self.near is not None else 0, 10_000):
            s = self.score[at : at + 10_000]
            i, j = np.nonzero(s != FREE)
            found = s[i, j]
            yield self.keys[at + i], self.near[at + i, j], pa.array(np.where(found == UNDEFINED, np.nan, found), mask=found == NONE)


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query, key, rank, similarity: the k most cosine-similar vectors of each query, ties by key; exact.

    Blocks of vectors are multiplied with all queries of a pass; what a product shows to be near is
    summed again in the order of the numbers. A task keeps k rows a query, which is what is shuffled.
    Passes have PASS_QUERIES queries, so memory does not grow with their number.
    """
    spark, none = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    ship(spark)
    q = queries.select(F.col(key).alias("query"), F.col(column).alias("q")).filter("query is not null")
    passes = max(1, -(-q.count() // PASS_QUERIES))
    v = vectors.select(key, column).filter(F.col(key).isNotNull()).repartition(spark.sparkContext.defaultParallelism)
    found = []
    for n in range(passes):
        held = q.filter(F.pmod(F.xxhash64("query"), F.lit(passes)) == n).toArrow()
        sent = spark.sparkContext.broadcast((held["query"].to_pylist(), pa.concat_arrays(held["q"].chunks) if held.num_rows else None))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keys, own = sent.value
            if own is None:
                return
            nearest = _Nearest(keys, own, k)
            for b in batches:
                if b.num_rows:
                    nearest.offer(b.column(0).to_numpy(zero_copy_only=False), b.column(1))
            for a, x, s in nearest.rows():
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(x), s], ["query", key, "similarity"])

        found.append(v.mapInArrow(run, f"query {none}, `{key}` {none}, similarity double"))
    near = reduce(DataFrame.unionByName, found).withColumn("similarity", F.round("similarity", 10))
    final = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return near.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query", key, "rank", "similarity")
