"""Helpers that several training-data operators share.

Words are maximal runs of bytes other than ``\\x20 \\x09-\\x0D`` and only A-Z is lower-cased.
``bytes.split()`` and ``bytes.lower()`` do exactly that on UTF-8, where no byte of a
multi-byte character is an ASCII byte.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship

WHITE = "[\\x20\\x09-\\x0D]+"
#: Rows that one broadcast of ids may have; beyond it the same join shuffles.
BROADCAST_IDS = 4_000_000


#: Rows of an Arrow batch: whole texts, so far fewer than Spark's own default, in both Python and the JVM.
BATCH_ROWS = 2_000


def prepare(spark: SparkSession) -> None:
    """Ship the package and keep Arrow batches of whole texts small; a smaller setting of the session stays.

    Plans run after this call returns, so the setting stays with the session.
    """
    ship(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset and all run on this machine, one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.gettempdir()}/quadrel-shared"
    os.makedirs(own.removeprefix("file://"), exist_ok=True)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quadrel/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    prepare(spark)
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quadrel_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote; only for tables that nothing lazy still reads."""
    path = getattr(df, "_quadrel_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def keep_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id", limit: int = BROADCAST_IDS) -> DataFrame:
    """Rows of docs whose key is in ids: by broadcast if ids are few enough (counted), else by shuffle."""
    few = ids.limit(limit + 1).count() <= limit
    return docs.join(F.broadcast(ids) if few else ids, key, "left_semi")


def give_back() -> None:
    """Return memory that this worker has freed to the system: workers stay, and later tasks and stages need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


#: What this worker remembers from task to task, by name: what empties it.
KEPT: dict[str, Callable[[], None]] = {}


def forget(keeps: str | None = None) -> None:
    """Empty what this worker remembers, but for ``keeps``."""
    for name, empty in KEPT.items():
        if name != keeps:
            empty()


def spare(of_group: Callable) -> Callable:
    """of_group, a function of one large group, which gives freed memory back when it is done."""

    def inner(group):
        forget()
        out = of_group(group)
        give_back()
        return out

    return inner


def tidy(run: Callable[[Iterable], Iterator], each: bool = False, keeps: str | None = None) -> Callable[[Iterable], Iterator]:
    """run, which gives freed memory back when its task begins and ends; with ``each``, after every batch too.

    What earlier stages remembered in this worker (``KEPT``) is forgotten first, but for ``keeps``.
    """

    def inner(batches: Iterable) -> Iterator:
        forget(keeps)
        give_back()
        for batch in run(batches):
            yield batch
            if each:
                give_back()
        give_back()

    return inner


def collect_garbage(spark: SparkSession) -> None:
    """Have every executor's JVM collect and shrink its heap: else what one stage left there stands beside the next one's workers."""
    executors = max(1, len(spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()) - 1)
    # an idle cluster deals as many tasks as executors one to each; not deterministic, so it runs there
    spark.range(0, executors, 1, executors).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wraps on purpose)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b); component is the smallest node.

    Alternating large-star and small-star steps; each round is two group-bys on node keys,
    written to the shared folder. A star that a third of all nodes point at is a plain
    ``min`` with map-side combining, never a collected list.
    """
    e = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v").distinct()
    e = materialise(e, name)
    last = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        nxt = materialise(small, name)
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e)
        e = nxt
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
