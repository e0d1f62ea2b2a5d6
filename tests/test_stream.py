"""The change feed: a stream gives what a batch over all changes gives."""

from pyspark.sql import functions as F

from quadrel.streaming import sync

SCHEMA = "key bigint, ts timestamp, id bigint, op string, value double"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 17).alias("key"), F.timestamp_seconds(F.col("id") * 7 % 50).alias("ts"), "id", F.when(F.col("id") % 5 == 0, "delete").otherwise("update").alias("op"), (F.col("id") * 1.5).alias("value"))
    src = str(tmp_path / "feed")
    rows.repartition(6).write.parquet(src)
    p = sync.Projection(spark, f"file://{tmp_path}/p", SCHEMA)
    feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(src)
    p.run(feed).awaitTermination()
    want = sorted(map(tuple, sync.live(sync.last_changes(rows)).select("key", "id", "op", "value").collect()))
    assert sorted(map(tuple, sync.live(p.state()).select("key", "id", "op", "value").collect())) == want
    assert p.audit().count() == 3
    source = sync.live(p.state()).select("key", "id", "op", "value").withColumn("value", F.when(F.col("key") == 3, 0.0).otherwise(F.col("value")))
    assert p.reconcile(source.join(p.state().select("key", "ts"), "key").select("key", "ts", "id", "op", "value")).count() <= 1
