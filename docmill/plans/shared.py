"""Intermediate tables in the folder that driver and executors share, and size-checked joins.

A written table cuts lineage: when an executor is lost, later stages read the table again instead
of recomputing what led to it, and non-deterministic row numbers stay as they were written.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that joins may broadcast; more rows take a shuffle join.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a new temporary folder only where it is unset and driver and workers are one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docmill-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, label: str, keep: list[str] | None = None) -> str:
    """A new name in the shared folder; what is written there goes when the driver ends. keep: gets the name, so that ``release`` can remove it earlier."""
    name = f"{shared_dir(spark)}/docmill/{label}-{uuid.uuid4().hex}"
    path, fs = _path(spark, name)
    fs.deleteOnExit(path)
    if keep is not None:
        keep.append(name)
    return name


def materialise(df: DataFrame, label: str, keep: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and return the table read back; it goes when the driver ends.

    keep: gets the path, so that ``release`` can remove the table earlier.
    """
    spark = df.sparkSession
    name = scratch(spark, label, keep)
    df.write.parquet(name)
    return spark.read.schema(df.schema).parquet(name)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that ``materialise`` wrote and that no DataFrame needs any more."""
    while paths:
        path, fs = _path(spark, paths.pop())
        fs.delete(path, True)


def join_checked(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS, weight: str | None = None) -> DataFrame:
    """Join big with a written small table on null-safe keys; broadcast it only if it proves small.

    small: its key columns have the names in keys. weight: an array column of small whose elements
    count as rows. Beyond max_rows Spark shuffles both sides, and AQE splits skewed partitions.
    """
    n = small.agg(F.sum(F.greatest(F.lit(1), F.size(weight))) if weight else F.count(F.lit(1))).first()[0] or 0
    right = small.select(*(F.col(k).alias(f"__right_{k}") for k in keys), *(c for c in small.columns if c not in keys))
    on = reduce(lambda a, b: a & b, (big[k].eqNullSafe(right[f"__right_{k}"]) for k in keys))
    joined = big.join(F.broadcast(right) if n <= max_rows else right, on, how)
    return joined.drop(*(f"__right_{k}" for k in keys))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows take much work each: dealt over all cores where fewer partitions than these hold its rows.

    A table of as many files as cores or more is read as it is, which takes no job to find out. In
    one of fewer files a job counts the partitions that hold row groups, from the footers alone.
    """
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    if len(rows.inputFiles()) >= cores:
        return rows
    filled = rows.select(F.spark_partition_id().alias("part")).distinct().count()
    return rows.repartition(cores) if filled < cores else rows
