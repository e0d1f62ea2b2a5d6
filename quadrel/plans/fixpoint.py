"""Fixpoints over edge tables: semi-naive rounds whose results are written to the shared folder.

Each round joins only what the last one added, drops what is known by an anti join and stops
when nothing is new; cycles end by that. Lineage is cut by ``DataFrame.checkpoint`` (files that
every executor can read); nothing depends on one executor's disk.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import ship

#: Edges among which one task finds strong components: some 300 MB.
TASK_EDGES = 1_000_000


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut at a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = f"file://{tempfile.gettempdir()}/quadrel-checkpoints"
            os.makedirs(where.removeprefix("file://"), exist_ok=True)
        sc.setCheckpointDir(where)
    return df.checkpoint()


class Grown:
    """A table that rounds add to: each part is written once, and many small parts are joined into one now and then."""

    def __init__(self, first: DataFrame, most: int = 16):
        self.parts, self.most = [first], most

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > self.most:
            self.parts = [cut(self.whole)]

    @property
    def whole(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def closure(edges: DataFrame, seeds: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """(src, dst) of all paths of one edge or more; with seeds (src), only from those; max_rounds caps the length."""
    e = edges.select("src", "dst").distinct()
    first = e if seeds is None else e.join(seeds.select("src").distinct(), "src", "left_semi")
    delta = cut(first)
    known = Grown(delta)
    step = cut(e.select(F.col("src").alias("dst"), F.col("dst").alias("next")))
    rounds = 1
    while not delta.isEmpty() and (max_rounds is None or rounds < max_rounds):
        found = delta.join(step, "dst").select("src", F.col("next").alias("dst")).distinct()
        delta = cut(found.join(known.whole, ["src", "dst"], "left_anti"))
        known.add(delta)
        rounds += 1
    return known.whole


def reach_with_depth(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst, depth): shortest number of edges from each seed, itself at 0."""
    step = cut(edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")).distinct())
    delta = cut(seeds.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(0).cast("bigint").alias("depth")))
    known, depth = Grown(delta), 0
    while not delta.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        found = delta.join(step, "dst").select("src", F.col("next").alias("dst"), F.lit(depth).cast("bigint").alias("depth")).distinct()
        delta = cut(found.join(known.whole, ["src", "dst"], "left_anti"))
        known.add(delta)
    return known.whole


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(pos, node) of one shortest path of any length, the smallest predecessor where several fit; no rows without a path."""
    spark = edges.sparkSession
    reached = reach_with_depth(edges, spark.range(1).select(F.lit(start).alias("src"))).select(F.col("dst").alias("node"), "depth")
    at, path = end, []
    row = reached.filter(F.col("node") == end).first()
    if row is None:
        return spark.createDataFrame([], "pos bigint, node string")
    for d in range(row["depth"], 0, -1):  # one row a step, as long as the path
        path.append((d, at))
        before = edges.filter(F.col("dst") == at).join(reached.filter(F.col("depth") == d - 1).select(F.col("node").alias("src")), "src").agg(F.min("src")).first()
        at = before[0]
    return spark.createDataFrame([(0, start), *reversed(path)], "pos bigint, node string")


def peel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, depth) of nodes from which no cycle is reached, depth being the edges on the longest path up; the edges left over).

    Round k takes the nodes all of whose targets went before, so rounds are as many as levels.
    """
    left = cut(edges.select("src", "dst").distinct())
    nodes = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
    fresh = cut(nodes.join(left.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(0).cast("bigint").alias("depth")))
    done, k = Grown(fresh), 0
    while not fresh.isEmpty():
        k += 1
        hit = left.join(fresh.select(F.col("node").alias("dst")), "dst", "left_semi").select("src").distinct()
        left = cut(left.join(fresh.select(F.col("node").alias("dst")), "dst", "left_anti"))
        fresh = cut(hit.join(left.select("src").distinct(), "src", "left_anti").select(F.col("src").alias("node"), F.lit(k).cast("bigint").alias("depth")))
        done.add(fresh)
    return done.whole, left


def longest_depth(edges: DataFrame, guarded: bool = False) -> DataFrame:
    """(node, depth): edges on the longest path up from the node (src -> dst is child -> parent).

    A node from which a cycle is reached has no longest path: an error, or with ``guarded`` depth null.
    """
    depth, left = peel(edges.filter("src <> dst"))
    if left.isEmpty():
        return depth
    if not guarded:
        raise ValueError("the graph has a cycle")
    return depth.unionByName(left.select(F.col("src").alias("node")).distinct().select("node", F.lit(None).cast("bigint").alias("depth")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): weakly connected, named by the smallest node; alternating star contraction."""
    e = cut(edges.select(F.least("src", "dst").alias("v"), F.greatest("src", "dst").alias("u")).distinct())
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    e = e.filter("u <> v")
    last = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        e = cut(large.join(low, "u").select(F.explode(pairs).alias("e")).select("e.u", "e.v").filter("u <> v").distinct())
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    parts = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(parts, nodes.node == parts.u, "left").select("node", F.coalesce("component", "node").alias("component"))


def core(edges: DataFrame) -> DataFrame:
    """Edges between nodes that reach a cycle and are reached from one: all that can lie on a cycle."""
    _, left = peel(edges)
    _, left = peel(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the groups of two or more among the edges of one task; an explicit stack, so paths may be long."""
    found = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if found is None or not len(found):
        return
    names = pa.chunked_array(found.column(0).chunks + found.column(1).chunks).unique()
    names = names.take(pc.sort_indices(names))  # so the smallest number of a group is its smallest name
    src, dst = (pc.index_in(found.column(i), names).to_numpy() for i in (0, 1))
    n = len(names)
    begin = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]).tolist()
    after, at = dst[np.argsort(src, kind="stable")].tolist(), begin[:-1]
    seen, low, own, stack, count = [0] * n, [0] * n, [-1] * n, [], 0
    for root in range(n):
        if seen[root]:
            continue
        path = [root]
        while path:
            v = path[-1]
            if not seen[v]:
                count += 1
                seen[v] = low[v] = count
                stack.append(v)
            if at[v] < begin[v + 1]:
                w = after[at[v]]
                at[v] += 1
                if not seen[w]:
                    path.append(w)
                elif own[w] < 0 and seen[w] < low[v]:
                    low[v] = seen[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == seen[v]:
                group = []
                while not group or group[-1] != v:
                    group.append(stack.pop())
                least = min(group)
                for w in group:
                    own[w] = least
    own = np.array(own)
    several = np.flatnonzero(np.bincount(own, minlength=n)[own] > 1)
    for lo in range(0, len(several), 100_000):
        part = several[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(part)), names.take(pa.array(own[part]))], ["node", "component"])


def _by_colour(edges: DataFrame) -> list[DataFrame]:
    """Groups of any number of edges: each node takes the smallest node that reaches it; a group is what reaches such a node among the nodes that took it."""
    groups, left = [], core(edges)
    while not left.isEmpty():
        colour = cut(left.select(F.col("src").alias("node")).distinct().withColumn("c", F.col("node")))
        while True:
            ahead = left.join(colour.select(F.col("node").alias("src"), F.col("c").alias("d")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("d").alias("d"))
            colour = cut(colour.join(ahead, "node", "left").select("node", F.least("c", "d").alias("c"), (F.col("d") < F.col("c")).alias("fell")))
            if colour.filter("fell").isEmpty():
                break
            colour = colour.drop("fell")
        ends = [colour.select(F.col("node").alias(x), F.col("c").alias(x[0])) for x in ("src", "dst")]
        same = cut(left.join(ends[0], "src").join(ends[1], "dst").filter("s = d").select("src", "dst"))
        delta = cut(colour.filter("node = c").select("node", F.col("c").alias("component")))
        known = Grown(delta)
        while not delta.isEmpty():
            delta = cut(same.join(delta.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "component").distinct().join(known.whole.select("node"), "node", "left_anti"))
            known.add(delta)
        done = cut(known.whole)
        groups.append(done)
        left = core(same.join(done.select(F.col("node").alias("src")), "src", "left_anti").join(done.select(F.col("node").alias("dst")), "dst", "left_anti"))
    return groups


def strong_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component): mutually reachable nodes, named by the smallest member; only groups of two or more.

    A task finds the groups among its own edges, which then shrink to their names. While there are more than
    ``task_edges`` edges, ranges of nodes are shrunk so, each by a task; what no longer shrinks goes by colours,
    in rounds as many as paths are long. So the groups are exact at any size.
    """
    spark = edges.sparkSession
    ship(spark)
    kind = edges.schema["src"].dataType.simpleString()
    local = lambda e: cut(e.mapInArrow(_lists, f"node {kind}, component {kind}"))
    left = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    n, groups = left.count(), None

    def joined(found: DataFrame) -> DataFrame:
        """Groups of groups: a name of a former group stands for its members."""
        if groups is None:
            return found
        up = found.select(F.col("node").alias("component"), F.col("component").alias("up"))
        members = groups.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        return members.unionByName(found.join(groups.select("node"), "node", "left_anti"))

    while n > task_edges:
        found = local(left.repartitionByRange(-(-2 * n // task_edges), "src"))
        groups = cut(joined(found))
        for x in ("src", "dst"):
            left = left.join(found.select(F.col("node").alias(x), "component"), x, "left").withColumn(x, F.coalesce("component", x)).drop("component")
        before, left = n, cut(left.select("src", "dst").filter("src <> dst").distinct())
        n = left.count()
        if n > 0.9 * before:
            break
    found = local(left.coalesce(1)) if n <= task_edges else reduce(DataFrame.unionByName, _by_colour(left), spark.createDataFrame([], f"node {kind}, component {kind}"))
    out = joined(found)
    size = out.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")
    return out.join(size, "component", "left_semi").select("node", "component")


def has_cycle(edges: DataFrame) -> bool:
    return not peel(edges)[1].isEmpty()
