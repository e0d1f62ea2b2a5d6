"""Exact deduplication as a stateful stream (operator 7).

A fingerprint table (key digest, doc_id, content locator) is streamed through a keyed aggregation
whose state lives in RocksDB on disk and never expires: per digest it retains the smallest doc_id,
that row's locator and the number of rows. The locator is the row's file and its index there, and
rows are fetched by it. Rows whose digest hits a retained entry, and the retained row itself, are
fetched and compared in full: bodies under one digest are counted as they are, byte for byte, and a
digest with more than one is regrouped by body, so a collision never merges two texts. With a state
folder the state goes on: a later call streams only its own rows, and they meet what earlier calls
retained.

A digest may hold most rows: bodies and counts are combined before they are dealt by key.

Defined cases: a null text counts as empty; a null doc_id sorts after all others; of rows with
equal text and equal doc_id the first by file and index is kept; very long texts are compared whole;
an empty table gives an empty result; other columns of the input, whatever their names, are kept
by ``dedup``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE, BROADCAST_IDS, fresh_path, materialise

#: State on disk with little memory a partition, and no space reserved ahead.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
FILE, ROW = "__q_file", "__q_row"
KEEPER = "struct<no_id: boolean, doc_id: bigint, file: string, row: bigint>"


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def filed(docs: DataFrame) -> DataFrame:
    """docs as read from Parquet files; what is not is written first, so that every row has a locator."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
        return docs
    except AnalysisException:
        return materialise(docs, "located")


def located(docs: DataFrame) -> DataFrame:
    """Filed docs with the locator of every row."""
    return docs.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def fingerprints(docs: DataFrame, digest_chars: int = 64) -> DataFrame:
    """doc_id, text_sha256, digest (its first digest_chars), file and row of every row of located docs."""
    sha = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(_normal(F.col("text")), 256).alias("text_sha256"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))
    return sha.withColumn("digest", F.substring("text_sha256", 1, digest_chars))


def _keeper() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")).alias("keeper")


def stream_state(prints: DataFrame, path: str, files_per_batch: int | None = None, state_dir: str | None = None) -> DataFrame:
    """Run the stream over the fingerprint files at ``path`` to its end; the state of all keys it met: one row per digest."""
    spark = prints.sparkSession
    out = state_dir or fresh_path(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(prints.schema).option("recursiveFileLookup", "true")
        if files_per_batch:
            source = source.option("maxFilesPerTrigger", files_per_batch)
        keyed = source.parquet(path).groupBy("digest").agg(_keeper(), F.count(F.lit(1)).alias("group_size"))

        def put(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/state/n={number}")

        query = keyed.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = f"digest string, keeper {KEEPER}, group_size bigint, batch int"
    if not prints.take(1):
        return spark.createDataFrame([], state)
    written = spark.read.schema(state).option("recursiveFileLookup", "true").parquet(f"{out}/state")
    if not files_per_batch and not state_dir:
        return written
    return written.groupBy("digest").agg(F.max_by(F.struct("keeper", "group_size"), "batch").alias("x")).select("digest", "x.*")


def groups(docs: DataFrame, digest_chars: int = 64, files_per_batch: int | None = None, state_dir: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, file and row (its locator).

    With ``state_dir`` (in a shared folder) the state there goes on: keep_id and group_size cover
    the rows of earlier calls too, whose files must still be there.
    """
    docs = located(filed(docs)).select("doc_id", "text", FILE, ROW)
    prints = materialise(fingerprints(docs, digest_chars), "fingerprints")
    path = prints._quadrel_path
    if state_dir:
        prints.write.mode("append").parquet(f"{state_dir}/prints")
        path = f"{state_dir}/prints"
    state = stream_state(prints, path, files_per_batch, state_dir)
    multi = materialise(state.filter("group_size > 1").select("digest", "keeper", "group_size"), "hits")
    collided = _collisions(docs, prints, multi, state_dir)
    base = prints.join(multi, "digest", "left")
    alone = F.col("keeper").isNull()
    plain = base.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row"))).alias("kept"), "text_sha256", "file", "row", "digest",
    )
    if collided is None:
        return plain.drop("digest")
    return _regroup(plain, collided)


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """file, row, body of the rows that the locators (file, row) in wanted name."""
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    bodies = docs.select(F.col(FILE).alias("file"), F.col(ROW).alias("row"), _normal(F.col("text")).alias("body"))
    return bodies.join(F.broadcast(wanted) if few else wanted, ["file", "row"])


def _collisions(docs: DataFrame, prints: DataFrame, multi: DataFrame, state_dir: str | None) -> DataFrame | None:
    """Rows of all digests under which two bodies differ in any byte, with the bodies; None: there are none."""
    hits = prints.join(multi.select("digest"), "digest", "left_semi").select("digest", "doc_id", "file", "row")
    members = _fetch(docs, hits)
    if state_dir:
        spark = docs.sparkSession
        earlier = spark.read.schema(prints.schema).option("recursiveFileLookup", "true").parquet(f"{state_dir}/prints").join(multi.select("digest"), "digest", "left_semi")
        earlier = materialise(earlier.join(hits.select("file", "row"), ["file", "row"], "left_anti").select("digest", "doc_id", "file", "row"), "earlier")
        files = [r["file"] for r in earlier.select("file").distinct().toLocalIterator()]
        if files:
            members = members.unionByName(_fetch(located(spark.read.parquet(*files)), earlier))
    # copies are combined where they are read, so a digest with many rows is dealt as few
    bodies = members.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("bodies"))
    differ = materialise(bodies.filter("bodies > 1").select("digest"), "collisions")
    if differ.isEmpty():
        return None
    return materialise(members.join(differ, "digest", "left_semi"), "collided")


def _regroup(plain: DataFrame, collided: DataFrame) -> DataFrame:
    """Rows under a collided key digest again, grouped by body."""
    fine = plain.join(collided.select("digest").distinct(), "digest", "left_anti").drop("digest")
    best = collided.groupBy("digest", "body").agg(_keeper(), F.count(F.lit(1)).alias("group_size"))
    again = collided.join(best, ["digest", "body"]).select("file", "row", "keeper", "group_size")
    again = plain.select("doc_id", "text_sha256", "file", "row").join(again, ["file", "row"])
    kept = (F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row"))
    return fine.unionByName(again.select("doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "file", "row"))


def dedup(docs: DataFrame, state_dir: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    docs = filed(docs)
    found = groups(docs, state_dir=state_dir)
    gone = materialise(found.filter("not kept").select(F.col("file").alias(FILE), F.col("row").alias(ROW)), "copies")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return located(docs).join(F.broadcast(gone) if few else gone, [FILE, ROW], "left_anti").drop(FILE, ROW)
