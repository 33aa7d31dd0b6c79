"""File sources and sinks: tolerant readers, partitioned writers, a verified manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import filled, first_filled, safe_file_name

BOM = "﻿"


def read_csv(spark: SparkSession, path: str, place: bool = False) -> DataFrame:
    """A CSV table as text columns: the first line names them, a byte-order mark is cut off, nulls are empty.

    place: with __place, which orders rows by file and, as a file is read by one task, by line.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    at = [F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n")).alias("__place")] if place else []
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.removeprefix(BOM)) for c in rows.columns), *at)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents; what can't be read gives a row of nulls and its text in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)


def coalesced(rows: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Canonical columns, each the first filled of its candidates that rows has; empty if none."""
    return rows.select(*(first_filled(*(F.col(f"`{c}`") for c in found if c in rows.columns)).alias(n) for n, found in names.items()))


COURSES = {
    "course_code": ["course_code", "학수번호", "과목코드", "교과목코드"],
    "title": ["title", "course_name", "교과목명", "국문교과목명", "과목명"],
    "description": ["description", "해설", "교과목해설", "raw_text"],
    "credit": ["credit", "학점"],
    "semester": ["semester", "개설학기", "학기"],
    "grade": ["grade", "이수대상", "학년"],
    "course_type": ["course_type", "전공구분", "이수구분"],
}


def load_courses(spark: SparkSession, path: str) -> DataFrame:
    """Course rows in canonical columns; rows of failed crawls go, and nothing left is an error."""
    rows = read_csv(spark, path)
    if "record_type" in rows.columns:
        rows = rows.filter(~F.col("record_type").rlike("(?i)error"))
    if rows.isEmpty():
        raise ValueError(f"{path} holds no course")
    return coalesced(rows, COURSES)


def homepages(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """(department_name, department_url, college_name): the last row of a department wins.

    order: a column of the file that rises from row to row. Without it rows count by their file's
    name and their place in it.
    """
    own = read_csv(spark, path, place=True)
    own = own.withColumn("__n", F.struct(F.col(order).cast("double")) if order else F.col("__place"))
    return own.groupBy(F.trim("department_name").alias("department_name")).agg(F.max_by("department_url", "__n").alias("department_url"), F.max_by("college_name", "__n").alias("college_name"))


def refresh_dataset(existing: DataFrame, loaded: DataFrame, manual: Column) -> DataFrame:
    """A full refresh: manual rows of the old table stay, loaded ones replace the rest."""
    return existing.filter(manual).unionByName(loaded, allowMissingColumns=True)


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Chunks by dataset, so that a query reads the partitions of its route alone."""
    chunks.write.mode(mode).partitionBy("dataset").parquet(path)


def write_raw(records: DataFrame, path: str, as_of: Column) -> None:
    """Records as JSON under year and month of publication, of as_of where that is missing."""
    day = F.coalesce(F.try_to_date("published_at", "yyyy-MM-dd"), as_of.cast("date"))
    named = records.withColumns({"year": F.year(day), "month": F.month(day), "file": safe_file_name(F.col("document_key"))})
    named.write.mode("append").partitionBy("year", "month").json(path)


def export_active(documents: DataFrame, path: str) -> None:
    """Visible documents as CSV, newest first."""
    documents.filter(F.col("status").isin("active", "updated")).orderBy(F.desc("published_at"), F.desc("source_id")).write.mode("overwrite").option("header", True).csv(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of the files in a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def verified(hashes: DataFrame, manifest: DataFrame, strict: bool = False) -> DataFrame:
    """(name, sha256, accepted): a hash that differs is rejected, one that isn't listed only if strict."""
    listed = manifest.select("name", F.col("sha256").alias("__listed"))
    return hashes.join(listed, "name", "left").withColumn("accepted", F.coalesce(F.col("sha256") == F.col("__listed"), F.lit(not strict))).drop("__listed")


def non_empty_columns(rows: DataFrame) -> list[str]:
    """Names of the columns with a filled value, found in one pass."""
    counts = rows.agg(*(F.count(filled(F.col(f"`{c}`"))).alias(f"c{i}") for i, c in enumerate(rows.columns))).first()
    return [c for i, c in enumerate(rows.columns) if counts[f"c{i}"]]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_versioned(spark: SparkSession, path: str, cache: dict) -> DataFrame:
    """A Parquet table, kept in Spark's cache until one of its files changes."""
    newest = spark.read.parquet(path).select(F.max("_metadata.file_modification_time"), F.count_distinct("_metadata.file_path")).first()
    if path not in cache or cache[path][0] != newest:
        if path in cache:
            cache[path][1].unpersist()
        cache[path] = (newest, spark.read.parquet(path).cache())
    return cache[path][1]
