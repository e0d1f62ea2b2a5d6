"""Change feed to projection: a stream of keyed changes kept as the last state of every key.

Changes carry a sequence (ts, id). Each micro-batch is reduced to the last change a key, merged
into the current version and written as the next; a pointer row in the audit log names it, so a
replayed batch gives the same version again. ``reconcile`` compares projection and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def last_changes(changes: DataFrame, key: str = "key") -> DataFrame:
    """One row a key: its last change by (ts, id)."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", "id")).alias("c")).select(key, "c.*")


def merge_changes(state: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    """State after the changes; deletions stay as rows so that late older changes cannot revive a key."""
    return last_changes(state.select(*changes.columns).unionByName(changes), key)


def live(state: DataFrame) -> DataFrame:
    return state.filter("op <> 'delete'")


class Projection:
    """The state of all keys under a folder, one version a micro-batch."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def audit(self) -> DataFrame:
        return self.spark.read.schema("batch bigint, changes bigint, version string, at timestamp").parquet(f"{self.folder}/audit")

    def _version(self, before: int | None = None) -> str | None:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/audit")
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return None
        log = self.audit() if before is None else self.audit().filter(F.col("batch") < before)
        row = log.orderBy(F.desc("batch"), F.desc("at")).first()
        return row["version"] if row else None

    def state(self, before: int | None = None) -> DataFrame:
        version = self._version(before)
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{version}")

    def _apply(self, batch: DataFrame, number: int) -> None:
        version = f"state-{number}"
        merge_changes(self.state(number), batch).write.mode("overwrite").parquet(f"{self.folder}/{version}")
        row = batch.agg(F.lit(number).cast("bigint").alias("batch"), F.count("*").alias("changes"), F.lit(version).alias("version"), F.current_timestamp().alias("at"))
        row.write.mode("append").parquet(f"{self.folder}/audit")

    def run(self, changes: DataFrame, available_now: bool = True, every: str = "1 minute"):
        """Start the stream of changes (columns of the schema); returns the query."""
        writer = changes.writeStream.foreachBatch(self._apply).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()

    def reconcile(self, source: DataFrame, key: str = "key") -> DataFrame:
        """key, problem: what the projection lacks, has too much, or has otherwise than the source."""
        have, want = live(self.state()), source
        columns = [c for c in want.columns if c != key]
        j = want.select(key, F.struct(*columns).alias("w")).join(have.select(key, F.struct(*columns).alias("h")), key, "full")
        problem = F.when(F.col("h").isNull(), "missing").when(F.col("w").isNull(), "extra").when(~F.col("w").eqNullSafe(F.col("h")), "different")
        return j.select(key, problem.alias("problem")).filter("problem is not null")
