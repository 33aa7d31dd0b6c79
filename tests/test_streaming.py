import time

from pyspark.sql import functions as F

from docmill.operators import sync
from docmill.plans.shared import table
from docmill.streaming import jobs


def test_rate_counts_equal_batch(spark, sf, tmp_path):
    table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long").parquet(str(tmp_path / "in"))
    query = jobs.rate_counts(stream, "ts", "user_id", "1 hour", "60 days").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("rates").collect()))
    want = spark.read.parquet(str(tmp_path / "in")).groupBy(F.window("ts", "1 hour").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("w.start", "user_id", "n")
    assert got == sorted(map(tuple, want.collect())) and got
    assert jobs.over_limit(spark.table("rates"), 0).count() == len(got)


def test_sync_stream_equals_batch(spark, tmp_path):
    rows = lambda t, n, bad: [(str(i), f"h{i}{'x' if i % bad == 0 else ''}", i % 17 == 0, i % 2 == 0, t) for i in range(n)]
    schema = "source_id string, content_hash string, failed boolean, is_pinned boolean, seen_at long"
    first, second = spark.createDataFrame(rows(1, 60, 99), schema), spark.createDataFrame(rows(2, 40, 5), schema)
    paths = {k: str(tmp_path / k) for k in ("in", "state", "changes", "check")}
    for batch in (first, second):
        batch.coalesce(1).write.mode("append").parquet(paths["in"])
        jobs.sync_stream(spark.readStream.schema(schema).parquet(paths["in"]), paths["state"], paths["changes"], paths["check"], True).awaitTermination(120)
    got = spark.read.parquet(f"{paths['changes']}/batch=1")
    state = sync.diff(spark.createDataFrame([], "source_id string, content_hash string, status string, miss_count int, is_pinned boolean"), first)
    want = sync.diff(state.join(first.select("source_id", "is_pinned"), "source_id"), second)
    cols = ["source_id", "change", "status", "miss_count"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert {r.change for r in got.collect()} >= {"updated", "unchanged", "hidden", "missed", "parse_failed"}


def test_recent_answers(spark):
    import datetime

    now = datetime.datetime(2024, 1, 1, 12)
    old = now - datetime.timedelta(hours=1)
    asked = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 2, [0.0, 1.0]), ("a", 3, [0.6, 0.8])], "namespace string, asked_id long, embedding array<float>")
    cached = spark.createDataFrame([("a", 10, [1.0, 0.0], now), ("a", 11, [0.99, 0.141], now), ("b", 12, [0.0, 1.0], old)], "namespace string, cached_id long, embedding array<float>, created timestamp")
    got = [tuple(r) for r in jobs.recent_answers(asked, cached, now).collect()]
    assert got == [("a", 1, 10, 1.0)]


def test_cached_answers(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = "namespace string, question string, answer string"
        out = []
        for wanted, batch in ((3, [("a", "q1", "x"), ("a", "q2", "y"), ("b", "q1", "z")]), (5, [("a", "q1", "new"), ("b", "q3", None)])):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = jobs.cached_answers(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            query = stream.writeStream.foreachBatch(lambda df, n: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).start()
            until = time.time() + 100
            while len(out) < wanted and time.time() < until:  # a query with processing-time state never ends by itself
                time.sleep(0.2)
            query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert ("a", "q1", "x", True) in out and ("a", "q1", "x", False) in out and ("b", "q1", "z", False) in out and len(out) == 5
