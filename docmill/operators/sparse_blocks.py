"""A sparse index in blocks: postings by shard of texts and term, each block with its largest weight.

Every weight of a text is its term's idf over the text's length in idf, so texts of one length have
alike weights in all their terms. Shards are ranges of that length: short texts have large weights,
and a query's best shards are known from the blocks' largest weights alone. A search reads the best
shards of each query first, and then only those whose bound reaches the k-th score found: what it
returns is that of all texts, but of long texts, which hold most postings, few blocks are read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions.text import tokens
from docmill.operators.retrieval import MAX_TERMS, QUERY_BLOCK, column, idf_lengths, postings, ranked, tokenised, vocabulary
from docmill.plans.shared import join_checked, materialise, scratch

#: Ranges of length; postings of a shard, about.
LEVELS, SHARD_POSTINGS = 32, 2_000_000
#: Version of the folder's layout; scores are rounded to six digits, so a bound must be missed by more than that.
VERSION, SLACK = "2", 1e-6


@dataclass(frozen=True)
class SparseIndex:
    """An index folder: vocabulary (term, df, idf) and blocks (shard, term, n, most, keys, weights)."""

    spark: SparkSession
    path: str
    key: str
    n_texts: int

    def vocabulary(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vocabulary")

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")


def _shard(lengths: DataFrame, levels: int, shard_postings: int) -> Column:
    """A text's shard from its key and length: range by quantile, and part of the range so that a shard holds shard_postings, however many texts are alike."""
    cuts = sorted(set(lengths.approxQuantile("length", [i / levels for i in range(1, levels)], 0.01)))
    level = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= F.col("length")))
    sums = {r["level"]: r["n"] for r in lengths.groupBy(level.alias("level")).agg(F.sum(F.size("terms")).alias("n")).collect()}  # levels rows
    parts = F.array(*(F.lit(max(1, -(-int(sums.get(i, 0)) // shard_postings))) for i in range(len(cuts) + 1)))
    return level.cast("long") * (1 << 32) + F.pmod(F.xxhash64("key"), F.element_at(parts, level + 1))


def write_blocks(texts: DataFrame, path: str, key: str, text: str = "text", max_terms: int = MAX_TERMS, levels: int = LEVELS, shard_postings: int = SHARD_POSTINGS) -> SparseIndex:
    """Write the index of texts (key, text) and open it; keys are distinct, rows without one take no part.

    A null text has no terms; texts without a term of the vocabulary are in no block but count for
    idf. An empty table is an error, as there is nothing to learn from. The metadata are written last.
    """
    spark, terms = texts.sparkSession, tokenised(texts.filter(F.col(key).isNotNull()), key, text)
    n_texts = terms.count()
    if not n_texts:
        raise ValueError("there are no texts to index")
    vocabulary(terms, max_terms).orderBy("term").coalesce(1).write.mode("overwrite").parquet(f"{path}/vocabulary")
    words = spark.read.parquet(f"{path}/vocabulary").select("term", "idf").toArrow()  # max_terms rows
    term, idf = column(words, "term"), column(words, "idf").to_numpy()
    lengths = materialise(idf_lengths(terms, spark.read.parquet(f"{path}/vocabulary"), key).withColumnRenamed(key, "key"), "lengths")
    kind = lengths.schema["key"].dataType.simpleString()

    def blocks(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        lists, shard = column(rows, "terms"), rows["shard"][0]
        row = np.repeat(np.arange(len(rows)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        place = pc.index_in(lists.flatten(), value_set=term).to_numpy(zero_copy_only=False)
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        weight = idf[place] / column(rows, "length").to_numpy()[row]
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        ends = pa.array(np.append(start, len(place)).astype(np.int32))
        keys = pa.ListArray.from_arrays(ends, column(rows, "key").take(pa.array(row)))
        weights = pa.ListArray.from_arrays(ends, pa.array(weight))
        sizes = np.diff(np.append(start, len(place)))
        return pa.table([pa.repeat(shard, len(start)), term.take(pa.array(place[start])), pa.array(sizes), pa.array(np.maximum.reduceat(weight, start)), keys, weights], names=["shard", "term", "n", "most", "keys", "weights"])

    dealt = lengths.withColumn("shard", _shard(lengths, levels, shard_postings))
    made = dealt.groupBy("shard").applyInArrow(blocks, f"shard long, term string, n long, most double, keys array<{kind}>, weights array<double>")
    # by term, so that a filter on terms leaves out row groups
    materialise(made, "blocks").repartitionByRange("term", "shard").sortWithinPartitions("term", "shard").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/blocks")
    spark.createDataFrame([(json.dumps({"key": key, "n_texts": n_texts, "version": VERSION}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return read_blocks(spark, path)


def read_blocks(spark: SparkSession, path: str) -> SparseIndex:
    """Open an index folder; another version is an error."""
    about = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    if about["version"] != VERSION:
        raise ValueError(f"{path} has version {about['version']}, not {VERSION}")
    return SparseIndex(spark, path, about["key"], about["n_texts"])


def temporary(texts: DataFrame, key: str, text: str = "text", **options) -> SparseIndex:
    """An index in the shared folder that goes when the driver ends."""
    return write_blocks(texts, scratch(texts.sparkSession, "sparse"), key, text, **options)


def bounds(index: SparseIndex, asked: DataFrame, request: str) -> DataFrame:
    """(request, shard, bound): no text of the shard scores more. Reads the blocks' largest weights only."""
    both = join_checked(index.blocks().select("shard", "term", "most"), asked, ["term"], "inner")
    return both.groupBy(request, "shard").agg(F.sum(F.col("most") * F.col("asked")).alias("bound"))


def blocks_of(index: SparseIndex, wanted: DataFrame) -> DataFrame:
    """The blocks of wanted (shard, term and others), read by a filter on their terms where these are few."""
    pairs = materialise(wanted.select("shard", "term").distinct(), "pairs")
    found = [r["term"] for r in pairs.select("term").distinct().limit(1001).collect()]  # 1,001 rows at most
    blocks = index.blocks() if len(found) > 1000 else index.blocks().filter(F.col("term").isin(found) if found else F.lit(False))
    return join_checked(blocks, pairs, ["shard", "term"], "left_semi")


def _scores(index: SparseIndex, asked: DataFrame, pairs: DataFrame, request: str, k: int, n_requests: int) -> DataFrame:
    """(request, key, sparse_score): the k best texts of each request in its shards. A task gets a shard's blocks and a block of requests."""
    key, wanted = index.key, materialise(pairs.select(request, "shard").join(asked, request), "wanted")
    j = max(1, -(-n_requests // QUERY_BLOCK))
    blocks = blocks_of(index, wanted)
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    left = blocks.select("shard", "term", "keys", "weights", F.explode(F.sequence(F.lit(0), F.lit(j - 1))).alias("j"))
    right = wanted.select(request, "shard", "term", "asked", F.pmod(F.xxhash64(request), F.lit(j)).cast("int").alias("j"))
    kinds = f"`{request}` {asked.schema[request].dataType.simpleString()}, `{key}` {kind}, sparse_score double"

    def cell(some: pa.Table, block: pa.Table) -> pa.Table:
        lists = column(some, "keys")
        coded = lists.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()  # texts by key, which decides ties
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        text, weight = place[coded.indices.to_numpy()], column(some, "weights").flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(int)
        at = {t: (a, b) for t, a, b in zip(some["term"].to_pylist(), ends, ends[1:], strict=False)}
        own = block.sort_by(request)
        codes = column(own, request).dictionary_encode()
        number, terms, share = codes.indices.to_numpy(), own["term"].to_pylist(), own["asked"].to_numpy()
        cuts = [*np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])), len(number)] if len(number) else [0]
        who, which, score = [], [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            parts = [(*at[t], share[i]) for i, t in enumerate(terms[a:b], a) if t in at]
            if not parts:
                continue
            sums = np.bincount(np.concatenate([text[x:y] for x, y, _ in parts]), np.concatenate([weight[x:y] * s for x, y, s in parts]), len(order)).round(6)
            hit = np.flatnonzero(sums > 0)
            if len(hit) > k:
                hit = hit[sums[hit] >= np.partition(sums[hit], -k)[-k]]
            hit = hit[np.argsort(-sums[hit], kind="stable")][:k]
            who.append(np.full(len(hit), number[a]))
            which.append(hit)
            score.append(sums[hit])
        who, which, score = (np.concatenate(x) if x else np.zeros(0) for x in (who, which, score))
        keys = coded.dictionary.take(pa.array(order)).take(pa.array(which.astype(np.int64)))
        return pa.table([codes.dictionary.take(pa.array(who.astype(np.int64))), keys, pa.array(score)], names=[request, key, "sparse_score"])

    return ranked(left.groupBy("shard", "j").cogroup(right.groupBy("shard", "j")).applyInArrow(cell, kinds), request, "sparse_score", key, k).drop("rank")


def search(index: SparseIndex, queries: DataFrame, request: str, k: int, query: str = "query", first: int = 2) -> DataFrame:
    """(request, key, sparse_score): the k best texts of each query above zero by cosine of TF-IDF, ties by key; those of all texts.

    first: shards of each request that the first round reads, those of the largest bounds. Requests are
    distinct. Queries without a known term, and null ones, find nothing.
    """
    asked = materialise(postings(queries.select(request, tokens(F.col(query)).alias("terms")), index.vocabulary(), request).withColumnRenamed("weight", "asked"), "asked")
    n = queries.count()
    order = Window.partitionBy(request).orderBy(F.desc("bound"), "shard")
    around = materialise(bounds(index, asked, request).withColumn("place", F.row_number().over(order)), "bounds")
    hits = materialise(_scores(index, asked, around.filter(F.col("place") <= first), request, k, n), "hits")
    more = _scores(index, asked, remaining(around, hits, request, k, first), request, k, n)
    return ranked(hits.unionByName(more), request, "sparse_score", index.key, k).drop("rank")


def remaining(around: DataFrame, hits: DataFrame, request: str, k: int, first: int) -> DataFrame:
    """The shards of ``bounds``, with place, that the first round left and whose bound reaches the k-th of its hits."""
    least = hits.groupBy(request).agg(F.when(F.count(F.lit(1)) >= k, F.min("sparse_score")).alias("least"))
    return around.filter(F.col("place") > first).join(least, request, "left").filter(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK)
