"""Structured Streaming forms: rate counters, snapshot synchronisation in micro-batches, caches with expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from docmill.operators import sync


def rate_counts(events: DataFrame, time: str, key: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, key, n) of fixed windows; a window closes when the watermark passes it."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.filter(F.col("n") > limit)


def sync_stream(incoming: DataFrame, state_path: str, changes_path: str, checkpoint: str, detect_missing: bool = False, name: str = "sync") -> StreamingQuery:
    """Each micro-batch of records is diffed against the stored snapshot, which a new version then replaces.

    A batch writes snapshot and changes under its own number, so a batch that is run again after a
    failure starts from the version before it and gives the same result. The query's name admits
    one run at a time; an outer scheduler starts it on what is available.
    """
    empty = "source_id string, content_hash string, status string, miss_count int, is_pinned boolean"

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("source_id").agg(*(F.max_by(c, "seen_at").alias(c) for c in ("content_hash", "failed", "is_pinned")))
        old = spark.read.parquet(f"{state_path}/{number - 1}") if number else spark.createDataFrame([], empty)
        changes = sync.diff(old, last, detect_missing)
        pins = last.select("source_id", F.col("is_pinned").alias("pin")).unionByName(old.join(last, "source_id", "left_anti").select("source_id", F.col("is_pinned").alias("pin")))
        kept = changes.join(pins, "source_id", "left").select("source_id", "content_hash", "status", "miss_count", F.coalesce("pin", F.lit(False)).alias("is_pinned"))
        kept.write.mode("overwrite").parquet(f"{state_path}/{number}")
        changes.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{changes_path}/batch={number}")

    return incoming.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()


class AnswerCache(StatefulProcessor):
    """Per namespace and question: the first answer, kept for the state's time to live; a question that is there is a hit."""

    def __init__(self, ttl_ms: int = 1_800_000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answer = handle.getValueState("answer", StructType([StructField("answer", StringType())]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.answer.get()[0] if self.answer.exists() else None
        for batch in rows:
            out = []
            for answer in batch["answer"]:
                out.append((*key, known if known is not None else answer, known is not None))
                if known is None and answer is not None:
                    known = answer
                    self.answer.update((answer,))
            yield pd.DataFrame(out, columns=["namespace", "question", "answer", "hit"])

    def close(self) -> None:
        pass


def cached_answers(asked: DataFrame, ttl_ms: int = 1_800_000) -> DataFrame:
    """(namespace, question, answer, hit) of a stream of (namespace, question, answer): exact repeats within the time to live.

    The state is keyed by both, so a busy namespace spreads over tasks.
    """
    return asked.groupBy("namespace", "question").transformWithStateInPandas(AnswerCache(ttl_ms), "namespace string, question string, answer string, hit boolean", "Append", "ProcessingTime")


def cache_statistics(answers: DataFrame) -> DataFrame:
    """namespaces, size (different questions answered), hits and misses of ``cached_answers``' rows, over all namespaces."""
    per = answers.groupBy("namespace", "question").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.max(F.col("answer").isNotNull()).alias("kept"))
    return per.groupBy("namespace").agg(*(F.sum(c).alias(c) for c in ("hits", "misses")), F.count_if("kept").alias("size")).agg(
        F.count(F.lit(1)).alias("namespaces"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "hits", "misses"))
    )


def recent_answers(asked: DataFrame, cached: DataFrame, as_of, ttl_seconds: int = 1800, per_namespace: int = 500, least: float = 0.97) -> DataFrame:
    """Batch form of the semantic cache: each question's nearest cached one of its namespace, if similar enough and fresh.

    cached: namespace, cached_id, embedding, created; the newest per_namespace of each count. They
    are joined on the namespace, so a question meets per_namespace rows at most.
    """
    fresh = cached.filter(F.col("created") >= F.lit(as_of) - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    fresh = fresh.withColumn("__nth", F.row_number().over(Window.partitionBy("namespace").orderBy(F.desc("created"), "cached_id"))).filter(F.col("__nth") <= per_namespace)
    both = asked.join(fresh.select("namespace", "cached_id", F.col("embedding").alias("cached")), "namespace")
    score = F.aggregate(F.zip_with("embedding", "cached", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    both = both.withColumn("score", F.round(score, 6)).filter(F.col("score") >= least)
    return both.groupBy("namespace", "asked_id").agg(F.max_by("cached_id", F.struct("score", -F.col("cached_id"))).alias("cached_id"), F.max("score").alias("score"))
