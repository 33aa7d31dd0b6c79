"""Dense vectors of texts: a randomised low-rank projection of TF-IDF rows.

The projection spans the leading right singular vectors of the rows' matrix. They come from a random
start and a few products with the Gram matrix of the vocabulary, of which a pass over the rows gives the
product with a thin matrix: a task adds up its rows' share, and shares are summed in two levels. Only
that thin matrix, vocabulary by width, passes the driver; the rows are never gathered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import tokens
from docmill.operators.retrieval import MAX_TERMS, column, tokenised, vocabulary
from docmill.plans.shared import materialise, release

#: Length of a vector; further columns of the random start; products with the Gram matrix.
WIDTH, OVER, PASSES = 64, 16, 3
#: Terms of a share that travels as one row; shares that are summed at once.
BLOCK, FAN = 512, 32
#: Rows that are a dense matrix at once: MAX_TERMS columns at most.
AT_ONCE = 256
#: Prefixes that say what a text is (fixed values).
ROLES = ("query: ", "passage: ")


@dataclass(frozen=True)
class Encoder:
    """Terms, their idf, and the projection: a row of width numbers a term."""

    terms: pa.Array
    idf: np.ndarray
    projection: np.ndarray


def _rows(lists: pa.Array, terms: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of TF-IDF rows of length one, by row."""
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    term = pc.index_in(lists.flatten(), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
    row, term = row[term >= 0], term[term >= 0]
    own = idf[term]
    return row, term, own / np.sqrt(np.bincount(row, own * own, len(lists)))[row]


def _add(out: np.ndarray, to: np.ndarray, weight: np.ndarray, rows: np.ndarray, of: np.ndarray, step: int = 1 << 16) -> None:
    """Add weight * of[rows] to the rows of out that to names, a bounded number of entries at once."""
    order = np.argsort(to, kind="stable")
    for a in range(0, len(order), step):
        own = order[a : a + step]
        at = to[own]
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[start]] += np.add.reduceat(weight[own, None] * of[rows[own]], start)


def _times(lists: pa.Array, terms: pa.Array, idf: np.ndarray, thin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows' products with a thin matrix, and the rows' entries."""
    row, term, weight = _rows(lists, terms, idf)
    out = np.zeros((len(lists), thin.shape[1]))
    _add(out, row, weight, term, thin)
    return out, row, term, weight


def gram_times(rows: DataFrame, terms: pa.Array, idf: np.ndarray, thin: np.ndarray) -> np.ndarray:
    """The Gram matrix of the vocabulary (rows' matrix transposed, times itself) times thin. rows: (terms), written, each term once a row."""
    shape = thin.shape
    sent = rows.sparkSession.sparkContext.broadcast(thin)  # MAX_TERMS rows of WIDTH + OVER numbers at most

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, here = np.zeros(shape), False
        for b in batches:
            row, term, weight = _rows(b.column("terms"), terms, idf)
            cuts = np.searchsorted(row, np.arange(0, len(b) + AT_ONCE, AT_ONCE))
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                here_terms, place = np.unique(term[a:z], return_inverse=True)
                own = np.zeros((AT_ONCE, len(here_terms)))  # of the rows' own terms only
                own[row[a:z] % AT_ONCE, place] = weight[a:z]
                total[here_terms] += own.T @ (own @ sent.value[here_terms])
            here = here or len(b) > 0
        slot, blocks = TaskContext.get().partitionId() // FAN, list(range(0, shape[0], BLOCK)) if here else []
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([slot] * len(blocks), pa.int32()), pa.array([total[a : a + BLOCK].tobytes() for a in blocks], pa.binary())], names=["block", "slot", "sums"])

    def add(some: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in some["sums"])
        return pa.table([some["block"].slice(0, 1), pa.array([some["slot"][0].as_py() // FAN], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "slot", "sums"])

    kinds = "block int, slot int, sums binary"
    shares = rows.select("terms").mapInArrow(share, kinds)
    parts = rows.rdd.getNumPartitions()
    while parts > 1:  # FAN shares at a time
        shares = shares.groupBy("block", "slot").applyInArrow(add, kinds)
        parts = -(-parts // FAN)
    out = np.zeros(shape)
    for r in shares.collect():  # one share, MAX_TERMS rows at most
        part = np.frombuffer(r["sums"]).reshape(-1, shape[1])
        out[r["block"] : r["block"] + len(part)] += part
    return out


def fit_encoder(texts: DataFrame, key: str, text: str = "text", width: int = WIDTH, max_terms: int = MAX_TERMS, passes: int = PASSES, seed: int = 7) -> Encoder:
    """Learn the projection from all texts. Fewer terms than width give shorter vectors; no texts or no terms are an error."""
    spent: list[str] = []
    rows = tokenised(texts, key, text)
    words = materialise(vocabulary(rows, max_terms), "vocabulary", spent).orderBy("term").toArrow()
    release(rows.sparkSession, spent)
    terms, idf = column(words, "term"), column(words, "idf").to_numpy()
    if not len(terms):
        raise ValueError("there are no terms to learn from")
    n = min(width + OVER, len(terms))
    thin = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(terms), n)))[0]
    for _ in range(passes):
        thin = np.linalg.qr(gram_times(rows, terms, idf, thin))[0]
    values, turns = np.linalg.eigh(thin.T @ gram_times(rows, terms, idf, thin))
    best = np.argsort(-values, kind="stable")[: min(width, n)]
    projection = thin @ turns[:, best]
    return Encoder(terms, idf, projection * np.sign(projection[np.argmax(np.abs(projection), axis=0), np.arange(projection.shape[1])]))  # the largest part of each direction is positive


def encode(encoder: Encoder, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, embedding) of texts, queries and passages alike: vectors of length one.

    A prefix that tells a text's role says nothing about it here and is left off. A text without a known
    term, and a null one, has a null vector. Repeated rows get equal vectors; nothing is shuffled.
    """
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"^({'|'.join(ROLES)})", "")
    kind = texts.schema[key].dataType.simpleString()
    sent = texts.sparkSession.sparkContext.broadcast(encoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            out, *_ = _times(b.column("terms"), own.terms, own.idf, own.projection)
            norm = np.linalg.norm(out, axis=1)
            vectors = pa.array([v.tolist() if n > 1e-12 else None for v, n in zip(out / np.maximum(norm, 1e-300)[:, None], norm, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(key), vectors], names=[key, "embedding"])

    return texts.select(key, tokens(bare).alias("terms")).mapInArrow(run, f"`{key}` {kind}, embedding array<double>")


def write_encoder(encoder: Encoder, spark: SparkSession, path: str) -> None:
    """The encoder as a table of its terms, MAX_TERMS rows at most."""
    rows = [(t, float(i), p.tolist()) for t, i, p in zip(encoder.terms.to_pylist(), encoder.idf, encoder.projection, strict=True)]
    spark.createDataFrame(rows, "term string, idf double, projection array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/terms")
    spark.createDataFrame([(json.dumps({"width": encoder.projection.shape[1]}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def read_encoder(spark: SparkSession, path: str) -> Encoder:
    width = json.loads(spark.read.text(f"{path}/metadata").first()["value"])["width"]
    found = spark.read.parquet(f"{path}/terms").orderBy("term").toArrow()  # MAX_TERMS rows at most
    return Encoder(column(found, "term"), column(found, "idf").to_numpy(), column(found, "projection").flatten().to_numpy().reshape(-1, width))
