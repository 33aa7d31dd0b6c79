"""Run a stream over what is there, and read what it gave."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docmill.plans.shared import scratch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame, label: str, out: str | None = None, state: str | None = None) -> DataFrame:
    """The rows that a stream appends until its sources are used up, as a table in the shared folder.

    Keyed state with timers and maps needs the RocksDB state store; the session's own choice is put back.
    out, state: folders of an earlier run that this one goes on with, new ones if none are named.
    """
    spark = stream.sparkSession
    out, state = out or scratch(spark, label), state or scratch(spark, f"{label}-state")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(out)
