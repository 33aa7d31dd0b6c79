"""Sparse, dense and hybrid retrieval for a batch of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions.fixed import ALPHA, MIN_SCORE, TOP_K
from docmill.functions.text import tokens
from docmill.plans.shared import join_checked, materialise

#: Terms of a vocabulary; queries and rows that meet in one task of a grid; bytes of a block's vectors as doubles.
MAX_TERMS, QUERY_BLOCK, ROW_BLOCK, VECTOR_BYTES = 10_000, 4096, 100_000, 1 << 26


def tokenised(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, terms), written: both the vocabulary and the postings read it."""
    return materialise(texts.select(key, tokens(F.col(text)).alias("terms")), "terms")


def vocabulary(terms: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """(term, df, idf) of the most frequent terms of (key, terms), ties by term; idf = ln((1 + n) / (1 + df)) + 1. Every text counts.

    Terms are distinct per text, so counting rows counts texts, and sums form before the shuffle.
    """
    n = terms.count()
    df = terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    top = df.orderBy(F.desc("df"), "term").limit(max_terms)
    return top.withColumn("idf", F.log(F.lit(1.0 + n) / (F.col("df") + 1.0)) + 1.0)


def idf_lengths(terms: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, terms, length) of (key, terms) with a term of vocab: their known terms, and the root of the sum of squared idf. vocab: at most MAX_TERMS rows, so it is collected.

    A row's terms give its length: nothing is shuffled.
    """
    words = vocab.select("term", "idf").toArrow()
    known, idf = column(words, "term"), column(words, "idf").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = column(b, "terms")
            row = np.repeat(np.arange(len(b)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            place = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            row, place = row[place >= 0], place[place >= 0]
            n = np.bincount(row, minlength=len(b))
            there = np.flatnonzero(n)
            ends = pa.array(np.concatenate([[0], np.cumsum(n[there])]).astype(np.int32))
            length = np.sqrt(np.bincount(row, idf[place] ** 2, len(b)))[there]
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(there)), pa.ListArray.from_arrays(ends, known.take(pa.array(place))), pa.array(length)], names=[key, "terms", "length"])

    return terms.select(key, "terms").mapInArrow(run, f"`{key}` {terms.schema[key].dataType.simpleString()}, terms array<string>, length double")


def postings(terms: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, term, weight) of (key, terms): TF-IDF rows of length one. vocab: written, at most MAX_TERMS rows, so it is broadcast."""
    own = idf_lengths(terms, vocab, key)
    rows = join_checked(own.select(key, "length", F.explode("terms").alias("term")), vocab.select("term", "idf"), ["term"], "inner")
    return rows.select(key, "term", (F.col("idf") / F.col("length")).alias("weight"))


def sparse_index(texts: DataFrame, key: str, text: str = "text", max_terms: int = MAX_TERMS) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, postings), both written."""
    terms = tokenised(texts, key, text)
    vocab = materialise(vocabulary(terms, max_terms), "vocabulary")
    return vocab, materialise(postings(terms, vocab, key), "postings")


def ranked(hits: DataFrame, request: str, score: str, key: str, k: int) -> DataFrame:
    """The k best hits of each request, ties by key. Spark limits groups before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(request).orderBy(F.desc(score), key))
    return hits.withColumn("rank", nth).filter(F.col("rank") <= k)


def sparse_scores(queries: DataFrame, vocab: DataFrame, index: DataFrame, request: str, key: str, query: str = "query") -> DataFrame:
    """(request, key, sparse_score): cosines above zero of every query and row that share a term.

    The queries' terms are joined to the postings; join_checked broadcasts them while they are few.
    """
    terms = queries.select(request, tokens(F.col(query)).alias("terms"))
    asked = materialise(postings(terms, vocab, request).withColumnRenamed("weight", "asked"), "asked")
    both = join_checked(index, asked, ["term"], "inner")
    return both.groupBy(request, key).agg(F.round(F.sum(F.col("weight") * F.col("asked")), 6).alias("sparse_score")).filter("sparse_score > 0")


def sparse_summary(queries: DataFrame, terms: DataFrame, vocab: DataFrame, request: str, key: str, query: str = "query") -> DataFrame:
    """(request, n_hits, top_score): how many rows of (key, terms) score above zero with each query, and the best score. Requests without a hit have no row.

    A task counts what it scores and passes on a row per query: no table of queries and rows exists.
    """
    words = vocab.select("term", "idf").toArrow()
    asked = materialise(queries.select(request, tokens(F.col(query)).alias("terms")), "asked")
    kinds = f"`{request}` {asked.schema[request].dataType.simpleString()}, n long, top double"
    found = _scored(terms.select(key, "terms"), asked, request, key, kinds, lambda q: _Counted(q, words, request, key, 1))
    return found.groupBy(request).agg(F.sum("n").alias("n_hits"), F.max("top").alias("top_score"))


def sparse_topk(queries: DataFrame, terms: DataFrame, vocab: DataFrame, request: str, key: str, k: int, query: str = "query") -> DataFrame:
    """(request, key, sparse_score): the k best rows of (key, terms) per query, those above zero of ``sparse_scores``, ties by key.

    A row's terms stay together: a task scores them against a block of queries and passes on k per
    query, so no table of queries and rows exists. vocab: at most MAX_TERMS rows, so it is collected.
    """
    words = vocab.select("term", "idf").toArrow()
    asked = materialise(queries.select(request, tokens(F.col(query)).alias("terms")), "asked")
    return _best_rows(terms.select(key, "terms"), asked, request, key, "sparse_score", k, lambda q: _Sparse(q, words, request, key, k))


def dense_scores(queries: DataFrame, rows: DataFrame, request: str, key: str, k: int, vector: str = "embedding", keep: Column | None = None) -> DataFrame:
    """(request, key, dense_score): the k rows nearest to each query by cosine of unit vectors, exactly.

    Null vectors, those with null, infinite or NaN components and those of another length than the
    longest query's take no part.

    A task multiplies its rows with a block of queries and passes on its k best per query, so no
    pair table ever exists. keep: a filter on the rows that comes before the ranking.
    """
    rows = rows.filter(keep) if keep is not None else rows
    asked = materialise(queries.select(request, vector), "asked")
    width = asked.agg(F.max(F.size(vector))).first()[0] or 1
    return _best_rows(rows.select(key, vector), asked, request, key, "dense_score", k, lambda q: Dense(q, request, key, vector, k), row_block(width))


def row_block(width: int) -> int:
    """Vectors of this length that a task of a grid gets: ROW_BLOCK, or as many as VECTOR_BYTES hold."""
    return max(1, min(ROW_BLOCK, VECTOR_BYTES // (8 * max(1, width))))


def _best_rows(rows: DataFrame, asked: DataFrame, request: str, key: str, score: str, k: int, scorer: Callable[[pa.Table], _Scorer], block: int | None = None) -> DataFrame:
    """The k best rows of each query in asked, a written table. block: rows of a task of a grid."""
    kinds = f"`{request}` {asked.schema[request].dataType.simpleString()}, `{key}` {rows.schema[key].dataType.simpleString()}, {score} double"
    return ranked(_scored(rows, asked, request, key, kinds, scorer, block), request, score, key, k).drop("rank")


def _scored(rows: DataFrame, asked: DataFrame, request: str, key: str, kinds: str, scorer: Callable[[pa.Table], _Scorer], block: int | None = None) -> DataFrame:
    """What the scorers of all tasks found about the queries in asked, a written table.

    Up to QUERY_BLOCK queries go to the tasks as they are, and rows are not shuffled. More meet the
    rows in a grid: a block of rows and a block of queries per task, so each query meets all rows,
    nothing passes the driver, and rows are sent once for each block of queries. Rows without a key
    take no part.
    """
    rows = rows.filter(F.col(key).isNotNull())
    names = [f.split()[0].strip("`") for f in kinds.split(", ")]
    n = asked.count()
    if n <= QUERY_BLOCK:
        every_query = asked.toArrow()  # QUERY_BLOCK rows at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, kind = scorer(every_query), None
            for b in batches:
                kind = b.schema.field(key).type
                best.add(b)
            if kind is not None:
                yield from best.found(names, kind).to_batches()

        return rows.mapInArrow(run, kinds)

    def cell(some: pa.Table, queries: pa.Table) -> pa.Table:
        best = scorer(queries)
        for b in some.to_batches():
            best.add(b)
        return best.found(names, some.schema.field(key).type)

    i, j = -(-rows.count() // (block or ROW_BLOCK)), -(-n // QUERY_BLOCK)
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1)))
    left = rows.withColumn("__i", F.pmod(F.xxhash64(key), F.lit(max(i, 1)))).select("*", every(j).alias("__j"))
    right = asked.withColumn("__j", F.pmod(F.xxhash64(request), F.lit(j)).cast("int")).select("*", every(i).alias("__i"))
    left, right = (x.withColumns({c: F.col(c).cast("int") for c in ("__i", "__j")}) for x in (left, right))
    return left.groupBy("__i", "__j").cogroup(right.groupBy("__i", "__j")).applyInArrow(cell, kinds)


class _Scorer:
    """The k best rows so far of each query of a block; subclasses say how a batch of rows is scored."""

    #: Scores that are held at once.
    CELLS = 1 << 22

    def __init__(self, ids: pa.Array, key: str, k: int):
        self.ids, self.key, self.k, self.parts, self.waiting = ids, key, k, [], 0
        self.least = np.full(len(ids), -np.inf)  # the k-th best score

    def keep(self, keys: pa.Array, scores: np.ndarray, floor: float = -np.inf, queries: np.ndarray | None = None) -> None:
        """Take the rows' scores (row by query, of all or these queries) into account, those above floor. What ties with the k-th stays, so that the key can decide."""
        row, at = np.nonzero((scores >= (self.least if queries is None else self.least[queries])) & (scores > floor))
        self.parts.append(pd.DataFrame({"query": at if queries is None else queries[at], "key": keys.take(pa.array(row)).to_pandas(), "score": scores[row, at]}))
        self.waiting += len(row)
        if self.waiting > self.k * len(self.ids) + 100_000:
            self.settle()

    def settle(self) -> None:
        own = pd.concat(self.parts, ignore_index=True) if self.parts else pd.DataFrame({"query": [], "key": [], "score": []})
        own = own.sort_values(["query", "score", "key"], ascending=[True, False, True])
        own = own[own.groupby("query", sort=False).cumcount() < self.k]
        full = own.groupby("query")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.least[full.index.to_numpy().astype(int)] = full["min"]
        self.parts, self.waiting = [own], 0

    def found(self, names: list[str], kind: pa.DataType) -> pa.Table:
        self.settle()
        own = self.parts[0]
        query = self.ids.take(pa.array(own["query"].to_numpy().astype(np.int64)))
        return pa.table([query, pa.array(own["key"].tolist(), kind), pa.array(own["score"].to_numpy().astype(float))], names=names)


def column(block: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    found = block.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def sound_vectors(vector: str, width: int) -> Column:
    """Vectors of this length whose components are neither null nor infinite nor NaN."""
    return F.coalesce((F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


class Dense(_Scorer):
    """Inner products of rows with the queries of a block; a null or unsound vector, or one of another length than the queries', is no row."""

    def __init__(self, block: pa.Table, request: str, key: str, vector: str, k: int):
        super().__init__(column(block, request), key, k)
        own = column(block, vector)
        self.vector, self.width = vector, pc.max(pc.list_value_length(own)).as_py() or 0
        there, found = self._matrix(own)
        self.queries = np.full((len(own), self.width), np.nan)  # an unsound query scores NaN with every row and so finds none
        self.queries[there] = found

    def _matrix(self, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(places, vectors) of the sound ones."""
        there = np.flatnonzero(pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False) == self.width)
        own = vectors.take(pa.array(there)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(there), self.width)
        good = np.isfinite(own).all(axis=1)
        return there[good], own[good]

    def add(self, batch: pa.RecordBatch) -> None:
        self.score(batch, np.arange(len(self.ids)))

    def score(self, batch: pa.RecordBatch, queries: np.ndarray) -> None:
        """Score the rows with these queries."""
        if not len(batch) or not len(queries):
            return
        places, m = self._matrix(column(batch, self.vector))
        keys, step = column(batch, self.key).take(pa.array(places)), max(1, self.CELLS // len(queries))
        for a in range(0, len(m), step):
            self.keep(keys[a : a + step], (m[a : a + step] @ self.queries[queries].T).round(6), queries=queries)


class _Sparse(_Scorer):
    """TF-IDF cosines, by the queries' postings of each term that a row has."""

    def __init__(self, block: pa.Table, words: pa.Table, request: str, key: str, k: int):
        super().__init__(column(block, request), key, k)
        self.terms, self.idf = column(words, "term"), column(words, "idf").to_numpy()
        query, term, self.weight = self._weights(column(block, "terms"))
        order = np.argsort(term, kind="stable")
        self.query, self.weight = query[order], self.weight[order]
        self.start = np.searchsorted(term[order], np.arange(len(self.idf) + 1))

    def _weights(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) of rows of length one, by row."""
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy())
        term = pc.index_in(lists.flatten(), value_set=self.terms).fill_null(-1).to_numpy()
        row, term = row[term >= 0], term[term >= 0]
        idf = self.idf[term]
        return row, term, idf / np.sqrt(np.bincount(row, idf * idf, len(lists)))[row]

    def add(self, batch: pa.RecordBatch) -> None:
        keys = batch.column(self.key)
        if not len(keys) or not len(self.ids):
            return
        row, term, weight = self._weights(batch.column("terms"))
        each = self.start[term + 1] - self.start[term]  # queries that ask for the posting's term
        row, term, weight, each = row[each > 0], term[each > 0], weight[each > 0], each[each > 0]
        # rows go in slices that hold CELLS scores and about as many meetings of a posting with a query
        load = np.bincount(row, each, len(keys)) + len(self.ids)
        part = (np.cumsum(load) // self.CELLS).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(keys)]])
        at = np.searchsorted(row, cuts)
        for a, b, i, j in zip(cuts, cuts[1:], at, at[1:], strict=False):
            n = each[i:j]
            posting = np.repeat(np.arange(i, j), n)
            place = self.start[term[posting]] + np.arange(len(posting)) - np.repeat(np.cumsum(n) - n, n)
            sums = np.bincount((row[posting] - a) * len(self.ids) + self.query[place], weight[posting] * self.weight[place], (b - a) * len(self.ids))
            self.keep(keys[a:b], sums.reshape(b - a, -1).round(6), 0.0)


class _Counted(_Sparse):
    """How many rows score above zero with each query of a block, and the best score."""

    def __init__(self, block: pa.Table, words: pa.Table, request: str, key: str, k: int):
        super().__init__(block, words, request, key, k)
        self.n, self.top = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids))

    def keep(self, keys: pa.Array, scores: np.ndarray, floor: float = -np.inf, queries: np.ndarray | None = None) -> None:
        self.n += (scores > floor).sum(axis=0)
        self.top = np.maximum(self.top, scores.max(axis=0, initial=0.0))

    def found(self, names: list[str], kind: pa.DataType) -> pa.Table:
        hit = np.flatnonzero(self.n)
        return pa.table([self.ids.take(pa.array(hit)), pa.array(self.n[hit]), pa.array(self.top[hit])], names=names)


def similarity(distance: Column, space: str = "cosine") -> Column:
    """Similarity from a distance: 1 - d for cosine and inner product, 1 - d / 2 for l2; not below zero."""
    return F.greatest(F.lit(0.0), 1 - distance / (2 if space == "l2" else 1))


def hybrid(dense: DataFrame, sparse: DataFrame, chunks: DataFrame, request: str, key: str, k: int = TOP_K, alpha: float = ALPHA, keep: Column | None = None) -> DataFrame:
    """(request, key, vector_score, sparse_score, hybrid_score, rank, columns of chunks).

    Each side gives its 3k best; a missing side counts as zero; score = alpha * vector + (1 - alpha)
    * sparse. keep filters after both rankings, so fewer than k may be left; likewise keys that
    chunks doesn't have go after the cut to k.
    """
    sparse = ranked(sparse, request, "sparse_score", key, 3 * k).drop("rank")
    dense = ranked(dense, request, "dense_score", key, 3 * k).drop("rank")
    both = dense.join(sparse, [request, key], "full_outer").select(
        request, key, F.greatest(F.coalesce("dense_score", F.lit(0.0)), F.lit(0.0)).alias("vector_score"), F.coalesce("sparse_score", F.lit(0.0)).alias("sparse_score")
    )
    if keep is not None:
        both = both.join(chunks.filter(keep).select(key).distinct(), key, "left_semi")
    both = both.withColumn("hybrid_score", F.round(F.col("vector_score") * alpha + F.col("sparse_score") * (1 - alpha), 6))
    return ranked(both, request, "hybrid_score", key, k).join(chunks.dropDuplicates([key]), key)


def deadline_first(chunks: DataFrame, sparse: DataFrame, ranges: DataFrame, request: str, key: str, deadline: str, k: int = TOP_K) -> DataFrame:
    """Rows whose deadline lies in their request's range, all of them, then ranked: 0.85 sparse + 0.15 nearness.

    ranges: request, start, end (dates). Nearness falls from 1 at the start to 0 at the end, 1 in a
    one-day range. Zeros of the sparse score stay. Of more than 50 rows max(k, 50) stay. A range is
    joined by its days, so the join is one of equal dates.
    """
    days = ranges.select(request, "start", "end", F.explode(F.sequence("start", "end")).alias(deadline))
    own = chunks.join(days, deadline)
    own = own.join(sparse, [request, key], "left").withColumn("sparse_score", F.coalesce("sparse_score", F.lit(0.0)))
    span = F.datediff("end", "start")
    near = F.when(span > 0, 1 - F.least(F.lit(1.0), F.datediff(deadline, "start") / span)).otherwise(1.0)
    own = own.withColumn("hybrid_score", F.round(F.least(F.lit(1.0), MIN_SCORE + 0.85 * F.col("sparse_score") + 0.15 * near), 6))
    nth = F.row_number().over(Window.partitionBy(request).orderBy(F.desc("hybrid_score"), F.desc("sparse_score"), deadline, key))
    return own.withColumn("rank", nth).filter(F.col("rank") <= max(k, 50))


def date_filtered(hits: DataFrame, request: str, order: list, date: str, start: str, end: str, k: int = TOP_K) -> DataFrame:
    """Hits in the range; where these are fewer than min(k, hits), undated hits in order fill up, flagged.

    Adds date_unknown_auxiliary (0 or 1) and eliminated: the request had hits, but none in range.
    """
    per = Window.partitionBy(request)
    inside = F.coalesce((F.col(date) >= F.col(start)) & (F.col(date) <= F.col(end)), F.lit(False))
    own = hits.withColumns({"__in": inside.cast("int"), "__unknown": F.col(date).isNull().cast("int")})
    own = own.withColumns({"__n_in": F.sum("__in").over(per), "__room": F.least(F.lit(k), F.count(F.lit(1)).over(per)) - F.sum("__in").over(per), "__nth": F.row_number().over(Window.partitionBy(request, "__unknown").orderBy(*order))})
    kept = own.filter((F.col("__in") == 1) | ((F.col("__unknown") == 1) & (F.col("__nth") <= F.col("__room"))))
    return kept.withColumns({"date_unknown_auxiliary": 1 - F.col("__in"), "eliminated": F.col("__n_in") == 0}).drop("__in", "__unknown", "__n_in", "__room", "__nth")


def merged(hits: DataFrame, request: str, key: str, order: str, firsts: list[str]) -> DataFrame:
    """One row per request and key over several queries' hits: largest scores, first filled value of other columns in arrival order, queries in that order."""
    arrival = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("matched_query").alias("q"))))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    out = hits.groupBy(request, key).agg(*(F.max(c).alias(c) for c in ("hybrid_score", "vector_score", "sparse_score")), *map(first, firsts), F.array_distinct(F.transform(arrival, lambda x: x["q"])).alias("matched_queries"))
    return out.withColumn("matched_query_count", F.size("matched_queries"))


def relaxed(hits: DataFrame, request: str, strict: Column, wide: Column) -> DataFrame:
    """A request's hits that pass strict; where it has none, those that pass wide, with date_filter_relaxed."""
    own = hits.withColumns({"__strict": F.coalesce(strict, F.lit(False)), "__wide": F.coalesce(wide, F.lit(False))})
    own = own.withColumn("date_filter_relaxed", ~F.max("__strict").over(Window.partitionBy(request)))
    return own.filter(F.col("__strict") | (F.col("date_filter_relaxed") & F.col("__wide"))).drop("__strict", "__wide")


def dataset_k(dataset: Column, k: int = TOP_K) -> Column:
    """Hits that a dataset may give: twice k, of meals 40 at least."""
    return F.when(dataset == "meals", max(2 * k, 40)).otherwise(2 * k)


def by_dataset(requests: DataFrame, hits: DataFrame, request: str, route: str, key: str, k: int = TOP_K) -> DataFrame:
    """The best hits (request, dataset, key, hybrid_score) of each dataset on a request's route, ``dataset_k`` of each."""
    wanted = requests.select(request, F.explode(route).alias("dataset")).distinct()
    nth = F.row_number().over(Window.partitionBy(request, "dataset").orderBy(F.desc("hybrid_score"), key))
    return hits.join(wanted, [request, "dataset"]).withColumn("rank", nth).filter(F.col("rank") <= dataset_k(F.col("dataset"), k))


def unavailable(route: Column, available: list[str]) -> Column:
    """Datasets of a route that have no index; a request goes on with the others."""
    return F.array_distinct(F.array_except(route, F.array(*map(F.lit, available)).cast("array<string>")))


def second_route(route: Column, reason: Column) -> Column:
    """A request's route after its first try: rules join courses where that gave no answer (a reason) and rules weren't asked."""
    again = reason.isNotNull() & F.array_contains(route, "courses") & ~F.array_contains(route, "rules")
    return F.when(again, F.array_append(route, F.lit("rules"))).otherwise(route)


def with_second_chance(requests: DataFrame, hits: DataFrame, rules: DataFrame, request: str, route: str, reason: str) -> DataFrame:
    """hits and, for requests that ``second_route`` sends on, those of rules."""
    again = requests.filter(F.size(second_route(F.col(route), F.col(reason))) > F.size(route)).select(request)
    return hits.unionByName(rules.join(again, request, "left_semi"))


#: Version of what ``write_index`` writes.
INDEX_VERSION = "1"


def write_index(vocab: DataFrame, index: DataFrame, path: str, dataset: str, created_at: str) -> None:
    """A sparse index under path: vocabulary, postings, and one row of metadata, which is written last."""
    vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
    index.write.mode("overwrite").parquet(f"{path}/postings")
    n = vocab.sparkSession.read.parquet(f"{path}/postings").agg(F.lit(dataset).alias("dataset"), F.count(F.lit(1)).alias("n_postings"), F.lit(created_at).alias("created_at"), F.lit(INDEX_VERSION).alias("version"))
    n.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def read_index(spark: SparkSession, path: str, files: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vocabulary, postings, metadata) of an index folder that holds files; an older one has no metadata, less than both tables is an error."""
    if not {"vocabulary", "postings"} <= set(files):
        raise ValueError(f"{path} holds no index")
    kinds = "dataset string, n_postings long, created_at string, version string"
    about = spark.read.schema(kinds).json(f"{path}/metadata") if "metadata" in files else spark.createDataFrame([], kinds)
    return spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/postings"), about


def index_state(version: Column, runtime: str = INDEX_VERSION) -> Column:
    """legacy without a version, mismatch with another one, else ok."""
    return F.when(version.isNull(), "legacy").when(version != runtime, "mismatch").otherwise("ok")
