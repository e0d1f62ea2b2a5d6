"""Nearest neighbours of many queries, and of odd vectors."""

import random
import time

from pyspark.sql import Window, functions as F

from quadrel.operators import embed


def plain(vectors, queries, k):
    """The same by one product a pair."""
    q = queries.select(F.col("vec_id").alias("query"), embed.unit(F.col("embedding")).alias("q"))
    scored = vectors.select("vec_id", embed.unit(F.col("embedding")).alias("v")).crossJoin(q).select("query", "vec_id", F.round(embed.dot(F.col("q"), F.col("v")), 10).alias("similarity"))
    r = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "vec_id"))
    return sorted(map(str, scored.withColumn("rank", r).filter(F.col("rank") <= k).select("query", "vec_id", "rank", "similarity").collect()))


def test_odd_vectors(spark, monkeypatch):
    """Nulls, nulls within, zeros, NaN, several lengths, nothing at all, many copies; in one pass and in three."""
    r = random.Random(5)
    rows = [(i, [r.choice((-1.0, 0.0, 1.0, 2.0)) for _ in range(4)]) for i in range(60)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(60, 90)]
    rows += [(90, None), (91, [1.0, None, 2.0, 0.5]), (92, [0.0] * 4), (93, [float("nan"), 1.0, 0.0, 0.0]), (94, [1.0, 2.0]), (95, []), (96, [3.0, 1.0]), (97, None), (98, [])]
    r.shuffle(rows)
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    for few in (65_536, 35):
        monkeypatch.setattr(embed, "PASS_QUERIES", few)
        assert sorted(map(str, embed.knn(v, v, 4).collect())) == plain(v, v, 4)
    s = v.withColumn("vec_id", F.concat(F.lit("k"), "vec_id"))
    assert sorted(map(str, embed.knn(s, s.filter("vec_id < 'k4'"), 3).collect())) == plain(s, s.filter("vec_id < 'k4'"), 3)
    assert embed.knn(v.limit(0), v, 3).count() == 0 and embed.knn(v, v.limit(0), 3).count() == 0


def test_many_pairs_in_time(spark):
    """Fifty million pairs, which a product a pair does not do in time."""
    v = spark.range(50_000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.sin(F.col("id") * i).cast("float")).alias("embedding"))
    began = time.time()
    assert embed.knn(v, v.filter("vec_id % 50 = 0"), 5).count() == 5_000
    assert time.time() - began < 40
