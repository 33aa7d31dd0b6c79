"""Tables in buckets of their keys, of which an upsert rewrites only those it touches."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import sync
from docmill.plans.shared import materialise, release

BUCKETS = 64


def _bucket(keys: list[str], n: int) -> Column:
    """A key's bucket. Keys are hashed as text, so that an int and a long of one value agree."""
    return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(n)).cast("int")


def write_buckets(rows: DataFrame, path: str, keys: list[str], n: int = BUCKETS) -> None:
    """Write rows under ``bucket=<number>``; the keys and the number of buckets are kept beside them. Large buckets are several files."""
    spark = rows.sparkSession
    spark.createDataFrame([(json.dumps({"keys": keys, "n": n}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_layout")
    _write(rows.withColumn("bucket", _bucket(keys, n)), path, "static")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", mode).option("maxRecordsPerFile", 5_000_000).partitionBy("bucket").parquet(path + "/rows")


def read_buckets(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The table, or these buckets of it: the files of others are not read."""
    own = spark.read.parquet(path + "/rows")
    return own if buckets is None else own.filter(F.col("bucket").isin(buckets) if buckets else F.lit(False))


def _layout(spark: SparkSession, path: str) -> tuple[list[str], int]:
    about = json.loads(spark.read.text(f"{path}/_layout").first()["value"])
    return about["keys"], about["n"]


def upsert_buckets(spark: SparkSession, path: str, rows: DataFrame, order: str | None = None, gone: DataFrame | None = None) -> list[int]:
    """Put rows over those with their keys, remove the keys in gone, and return the buckets that were rewritten.

    Columns that one side lacks are null; new columns come with the buckets that have them (read with
    mergeSchema to see them in all). Of rows of one key the last by order counts, ties by the rows'
    text; without order keys must be distinct. A key in both rows and gone is kept. The new buckets
    are written aside first. A run that dies while they replace the old ones is made good by
    running it again: its result doesn't depend on which buckets are new already.
    """
    keys, n = _layout(spark, path)
    if order:
        last = F.max_by(F.struct(*rows.columns), F.struct(F.col(order), F.to_json(F.struct(*rows.columns))))
        rows = rows.groupBy(*keys).agg(last.alias("row")).select("row.*")
    spent: list[str] = []
    rows = materialise(rows.withColumn("bucket", _bucket(keys, n)), "rows", spent)
    lost = None if gone is None else materialise(gone.select(*keys).distinct().withColumn("bucket", _bucket(keys, n)), "gone", spent)
    named = rows.select("bucket") if lost is None else rows.select("bucket").unionByName(lost.select("bucket"))
    touched = sorted(r["bucket"] for r in named.distinct().collect())  # n rows at most
    left = read_buckets(spark, path, touched)
    left = left if lost is None else left.join(lost, [*keys, "bucket"], "left_anti")
    merged = materialise(sync.upsert(left, rows, [*keys, "bucket"]), "merged", spent)
    filled = {r["bucket"] for r in merged.select("bucket").distinct().collect()}  # n rows at most
    if filled:
        _write(merged, path, "dynamic")
    release(spark, [f"{path}/rows/bucket={b}" for b in touched if b not in filled])  # an overwrite leaves what it has no rows for
    release(spark, spent)
    return touched
