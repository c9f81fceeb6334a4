from __future__ import annotations

from pyspark.sql import functions as F

from tessera.streaming import cache

SF = "/root/testdata/sf0.001"


def _run(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def _events(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "events"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events"))


def test_first_within_ttl(spark, tmp_path):
    rows, stream = _events(spark, tmp_path)
    got = _run(spark, cache.first_within_ttl(stream, "user_id", ttl="60 days"), "firsts", "append")
    assert got.count() == rows.select("user_id").distinct().count()


def test_hits_by_window(spark, tmp_path):
    rows, stream = _events(spark, tmp_path)
    got = _run(spark, cache.hits_by_window(stream, "event_type", "value", window="1 day"), "hits", "complete")
    want = rows.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert got.join(want, ["start", "event_type", "n"]).count() == want.count() == got.count()
