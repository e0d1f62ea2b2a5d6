"""Strong components of long chains, and beyond what one task takes."""

import random
import time

import pytest

from quadrel.plans import fixpoint


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_strong_components_of_a_long_chain(spark):
    """Rings in a chain, each leading to the next: as many rounds as rings would not end in time."""
    n = 6000
    rings = [(f"s{k:06d}", f"s{k - 3 if k % 4 == 0 else k + 1:06d}") for k in range(1, n + 1)]
    edges = spark.createDataFrame(rings + [(f"s{k:06d}", f"s{k + 4:06d}") for k in range(1, n - 3)], "src string, dst string")
    began = time.time()
    assert values(fixpoint.strong_components(edges)) == [(f"s{k:06d}", f"s{(k - 1) // 4 * 4 + 1:06d}") for k in range(1, n + 1)]
    assert time.time() - began < 60


@pytest.mark.parametrize("task_edges", [1_000, 6, 1])
def test_strong_components_beyond_a_task(spark, task_edges):
    """Groups within a task's range, across ranges, and by colours only, as a plain closure gives them."""
    r = random.Random(3)
    pairs = {(r.randrange(14), r.randrange(14)) for _ in range(19)} | {(20, 21), (21, 20), (21, 22), (22, 23), (23, 22)}
    reach = set(pairs)
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    want = sorted((a, min(b for b in range(24) if (a, b) in reach and (b, a) in reach)) for a in range(24) if any(a != b and (a, b) in reach and (b, a) in reach for b in range(24)))
    assert values(fixpoint.strong_components(spark.createDataFrame(sorted(pairs), "src bigint, dst bigint"), task_edges)) == want
