"""An inverted-file vector index: lists of vectors around centroids, of which a query reads a few.

Centroids are fitted on a bounded sample; every vector is then put into the list of its nearest
centroid, and lists are Parquet partitions, so a search reads only files of lists that some query
probes. A list keeps its radius. With it a second round makes a search exact: it reads the lists
that can hold a better row than the k-th found so far, and no others.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.retrieval import QUERY_BLOCK, Dense, column, ranked, row_block, sound_vectors
from docmill.plans.shared import materialise, scratch

#: Vectors that centroids are fitted on, at most; lists, at most; turns of the fit.
FIT_VECTORS, MAX_LISTS, TURNS = 16_384, 1024, 12
#: Scores are rounded to six digits; a bound must be missed by more than that.
SLACK = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """An index folder. centroids: one row a list; radius: the farthest vector of a list from its centroid; n: its vectors; probes: lists that gave the wanted recall on the sample."""

    spark: SparkSession
    path: str
    key: str
    vector: str
    centroids: np.ndarray
    radius: np.ndarray
    n: np.ndarray
    probes: int

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """The vectors of these lists, or all: files of other lists are not read."""
        own = self.spark.read.parquet(f"{self.path}/lists")
        return own if lists is None else own.filter(F.col("list").isin(lists) if lists else F.lit(False))


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def fit_centroids(sample: np.ndarray, lists: int, turns: int = TURNS) -> np.ndarray:
    """Means of unit vectors that are nearest to each other, from evenly spaced rows of the sample on; an empty list keeps its centroid."""
    units = _units(sample)
    centroids = units[np.linspace(0, len(units) - 1, lists).astype(int)]
    for _ in range(turns):
        near = np.argmax(units @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, units)
        centroids = np.where((np.bincount(near, minlength=lists) > 0)[:, None], _units(sums), centroids)
    return centroids


def calibrated_probes(sample: np.ndarray, centroids: np.ndarray, recall: float, k: int, queries: int = 256) -> int:
    """The least number of lists that hold this share of the k nearest sample rows of some sample rows."""
    units = _units(sample)
    asked = sample[:: max(1, len(sample) // queries)]
    top = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, np.argmax(units @ centroids.T, axis=1)[top], 1).ravel())
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1


def _width(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have, the larger of equals."""
    found = rows.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found["size"] if found else 0


def write_vectors(rows: DataFrame, path: str, key: str, vector: str, lists: int | None = None, recall: float = 0.92, k: int = 15) -> VectorIndex:
    """Write the index of rows (key, vector and columns to filter by) and open it.

    lists: the square root of the number of vectors unless given, MAX_LISTS at most. Rows whose
    key or vector is null, or whose vector has null or non-finite components or another length than
    most, take no part; an empty table gives an index without lists. Large lists are several files. The metadata are
    written last: a folder without them holds no index.
    """
    spark, width = rows.sparkSession, _width(rows, vector)
    rows = rows.filter(F.col(key).isNotNull() & sound_vectors(vector, width))
    sample = rows.select(key, vector).orderBy(F.xxhash64(key), key).limit(FIT_VECTORS).toArrow()  # FIT_VECTORS rows at most
    total = rows.count()
    n = min(lists or max(1, round(total**0.5)), MAX_LISTS, max(1, sample.num_rows))
    vectors = column(sample, vector).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(sample.num_rows, max(1, width))
    centroids = fit_centroids(vectors, n) if len(vectors) else np.zeros((0, max(1, width)))
    probes = calibrated_probes(vectors, centroids, recall, k) if len(vectors) else 0

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(vector).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), -1) if len(b) else np.zeros((0, centroids.shape[1]))
            near = np.argmax(_units(own) @ centroids.T, axis=1) if len(own) else np.zeros(0, np.int64)
            far = np.linalg.norm(own - centroids[near], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(far), pa.array(near.astype(np.int32))], names=[*b.schema.names, "far", "list"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows.mapInArrow(assign, f"{kinds}, far double, list int").hint("rebalance", "list").write.mode("overwrite").partitionBy("list").option("maxRecordsPerFile", 1_000_000).parquet(f"{path}/lists")
    if not total:  # a partitioned write of no rows leaves no file to take the columns from
        rows.select("*", F.lit(0.0).alias("far"), F.lit(0).alias("list")).write.mode("overwrite").parquet(f"{path}/lists")
    per = {r["list"]: r for r in spark.read.parquet(f"{path}/lists").groupBy("list").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}  # MAX_LISTS rows at most
    about = [(i, c.tolist(), float(per[i]["far"]) if i in per else 0.0, int(per[i]["n"]) if i in per else 0) for i, c in enumerate(centroids)]
    spark.createDataFrame(about, "list int, centroid array<double>, radius double, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    spark.createDataFrame([(json.dumps({"key": key, "vector": vector, "probes": probes, "width": width}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return read_vectors(spark, path)


def read_vectors(spark: SparkSession, path: str) -> VectorIndex:
    """Open an index folder: its centroids and metadata are small, its lists are read by searches."""
    about = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    found = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # MAX_LISTS rows at most
    centroids = np.array([r["centroid"] for r in found], float).reshape(len(found), max(1, about["width"]))
    return VectorIndex(spark, path, about["key"], about["vector"], centroids, np.array([r["radius"] for r in found]), np.array([r["n"] for r in found], np.int64), about["probes"])


class _Probed(Dense):
    """Scores of rows with the queries that probe their list."""

    def __init__(self, block: pa.Table, request: str, key: str, vector: str, k: int):
        super().__init__(block, request, key, vector, k)
        self.by_list: dict[int, list[int]] = {}
        for i, lists in enumerate(column(block, "lists").to_pylist()):
            for n in lists or ():
                self.by_list.setdefault(n, []).append(i)

    def add(self, batch: pa.RecordBatch) -> None:
        lists = column(batch, "list").to_numpy()
        for n in np.unique(lists):
            if int(n) in self.by_list:
                self.score(batch.filter(pa.array(lists == n)), np.array(self.by_list[int(n)]))


def _best(index: VectorIndex, asked: DataFrame, request: str, k: int, keep: Column | None) -> DataFrame:
    """(request, key, dense_score) of each query of asked (request, vector, lists), a written table, in its lists.

    Up to QUERY_BLOCK queries go to the tasks as they are. More meet the rows list by list, in cells of
    a block of a list's rows and a block of its queries, so neither a list nor its queries must fit.
    """
    key, vector, names = index.key, index.vector, [request, index.key, "dense_score"]
    kinds = f"`{request}` {asked.schema[request].dataType.simpleString()}, `{key}` {index.rows().schema[key].dataType.simpleString()}, dense_score double"
    total = asked.count()
    per = asked.select(F.explode("lists").alias("list")).groupBy("list").count().collect()  # MAX_LISTS rows at most
    rows = index.rows(sorted(r["list"] for r in per))
    rows = (rows.filter(keep) if keep is not None else rows).select(key, vector, "list")

    def found(block: pa.Table, batches, kind: pa.DataType) -> pa.Table:
        best = _Probed(block, request, key, vector, k)
        for b in batches:
            best.add(b)
        return best.found(names, kind)

    if total <= QUERY_BLOCK:
        block = asked.toArrow()  # QUERY_BLOCK rows at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = next(batches, None)
            if first is not None:
                yield from found(block, (b for part in ([first], batches) for b in part), first.schema.field(key).type).to_batches()

        return ranked(rows.mapInArrow(run, kinds), request, "dense_score", key, k).drop("rank")

    size = lambda n, most: max(1, -(-int(n) // most))
    cells = index.spark.createDataFrame([(r["list"], size(index.n[r["list"]], row_block(index.centroids.shape[1])), size(r["count"], QUERY_BLOCK)) for r in per], "list int, i_n int, j_n int")
    cells, every = F.broadcast(cells), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(cells, "list").select(key, vector, "list", F.pmod(F.xxhash64(key), F.col("i_n")).cast("int").alias("i"), every("j_n").alias("j"))
    right = asked.select(request, vector, F.explode("lists").alias("list")).join(cells, "list")
    right = right.select(request, vector, F.array("list").alias("lists"), "list", F.pmod(F.xxhash64(request), F.col("j_n")).cast("int").alias("j"), every("i_n").alias("i"))
    cell = lambda some, block: found(block, some.to_batches(), some.schema.field(key).type)
    hits = left.groupBy("list", "i", "j").cogroup(right.groupBy("list", "i", "j")).applyInArrow(cell, kinds)
    return ranked(hits, request, "dense_score", key, k).drop("rank")


def _with_lists(index: VectorIndex, asked: DataFrame, request: str, vector: str, probes: int, least: str | None = None) -> DataFrame:
    """asked (request, vector) with lists: the nearest probes, or of the others those whose bound reaches the column least (null: any)."""
    centroids, radius, name = index.centroids, index.radius, index.vector

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(vector).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), -1) if len(b) else np.zeros((0, centroids.shape[1]))
            near = own @ centroids.T
            order = np.argsort(-near, axis=1, kind="stable")
            lists = [line[:probes].tolist() for line in order]
            if least:
                floor = b.column(least).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                bound = near + np.linalg.norm(own, axis=1)[:, None] * radius[None, :]
                lists = [[int(n) for n in line[probes:] if bound[i, n] >= floor[i] - SLACK] for i, line in enumerate(order)]
            yield pa.RecordBatch.from_arrays([b.column(request), b.column(vector), pa.array(lists, pa.list_(pa.int32()))], names=[request, name, "lists"])

    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    out = asked.select(request, vector, *([least] if least else [])).mapInArrow(run, f"`{request}` {kinds[request]}, `{name}` {kinds[vector]}, lists array<int>")
    return materialise(out.filter(F.size("lists") > 0), "asked")


def search(index: VectorIndex, queries: DataFrame, request: str, vector: str, k: int, probes: int | None = None, keep: Column | None = None, exact: bool = False) -> DataFrame:
    """(request, key, dense_score): the k best rows of each query by inner product, ties by key, among its nearest lists.

    probes: lists a query reads, by default what gave the recall that the index was written for.
    keep: a filter on the index's columns that comes before the ranking, so k rows are found among
    those that pass. exact: a second round reads the lists that the first can't rule out, and the
    result is that of all rows. Requests are distinct; queries whose vector is null, unsound or of
    another length find nothing, as do all in an empty index.
    """
    probes = max(1, min(probes or index.probes, max(1, len(index.centroids))))
    asked = queries.filter(sound_vectors(vector, index.centroids.shape[1])).select(request, vector)
    hits = _best(index, _with_lists(index, asked, request, vector, probes), request, k, keep)
    if not exact or probes >= len(index.centroids):
        return hits
    hits = materialise(hits, "hits")
    least = hits.groupBy(request).agg(F.when(F.count(F.lit(1)) >= k, F.min("dense_score")).alias("least"))
    again = _with_lists(index, asked.join(least, request, "left"), request, vector, probes, "least")
    return ranked(hits.unionByName(_best(index, again, request, k, keep)), request, "dense_score", index.key, k).drop("rank")


def temporary(rows: DataFrame, key: str, vector: str, **options) -> VectorIndex:
    """An index in the shared folder that goes when the driver ends."""
    return write_vectors(rows, scratch(rows.sparkSession, "vectors"), key, vector, **options)
