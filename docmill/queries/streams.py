"""Queries that run streams with keyed state over the tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.plans.shared import materialise, scratch, table
from docmill.queries import reports
from docmill.streaming import answers as stream_answers
from docmill.streaming import keyed_sync, semantic
from docmill.streaming.drain import drained


def sync_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes that one run of records makes to the documents known before it."""
    path = scratch(spark, "records")
    own = reports._incoming(spark, sf_dir).select("source_id", "content_hash", "failed", F.lit(False).alias("is_pinned"), F.lit("2026-01-01").cast("timestamp").alias("run_at"), F.lit(0).cast("long").alias("seen_at"))
    own.write.parquet(path)
    stream = spark.readStream.schema(own.schema).parquet(path)
    found = drained(keyed_sync.sync_changes(stream, True, reports._snapshot(spark, sf_dir)), "changes")
    return found.drop("run_at")


def cache_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each label as questions, one a second, some without an answer of their own."""
    path, key = scratch(spark, "questions"), F.col("vec_id")
    moment = F.timestamp_seconds(F.lit(1_767_225_600) + key)
    own = table(spark, sf_dir, "embeddings").select(F.col("label").alias("namespace"), key.alias("asked_id"), "embedding", F.when(key % 9 > 0, F.concat(F.lit("a"), key)).alias("answer"), moment.alias("asked_at"))
    own.write.parquet(path)
    return drained(semantic.semantic_answers(spark.readStream.schema(own.schema).parquet(path), least=0.35, most=50, ttl=300.0), "answers")


def answer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as streamed answers, cut into pieces of 37 bytes that come in three batches, each of as many files as its tasks write."""
    path, state, out = scratch(spark, "pieces"), scratch(spark, "events-state"), scratch(spark, "events")
    line = F.concat(F.lit("data: "), F.to_json(F.struct(F.when(F.col("role") == "system", "metadata").otherwise("text").alias("type"), F.col("text").alias("content"))), F.lit("\n\n"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "").cast("binary")  # a conversation's turns
    whole = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session")).agg(body.alias("body"))
    cut = F.expr("transform(sequence(0, int((length(body) - 1) / 37)), i -> struct(i as seq, substring(body, i * 37 + 1, 37) as piece, i = int((length(body) - 1) / 37) as done))")
    own = materialise(whole.select("session", F.explode(cut).alias("p")).select("session", F.col("p.seq").cast("long").alias("seq"), "p.piece", "p.done"), "pieces")
    size = own.groupBy("session").agg(F.max("seq").alias("last"))
    for k in range(3):  # what a run finds new is a batch
        own.join(size, "session").filter(F.floor(F.col("seq") * 3 / (F.col("last") + 1)) == k).drop("last").write.mode("append").parquet(path)
        events = drained(stream_answers.answer_events(spark.readStream.schema(own.schema).parquet(path)), "events", out, state)
    found = stream_answers.answers(events)
    return found.select("session", F.length("answer").alias("n_chars"), F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


QUERIES = {f.__name__: f for f in (sync_keyed, cache_stream, answer_stream)}
ORACLES = {
    "answer_stream": """SELECT conv_id::VARCHAR AS session, length(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role <> 'system'), ''))::INT AS n_chars, md5(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role <> 'system'), '')) AS answer_md5 FROM conversations GROUP BY conv_id""",
    "sync_keyed": reports.ORACLES["sync_diff"] + " WHERE change <> 'untouched'",
}
