"""The vector index and the sparse index in blocks, against exhaustive search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import retrieval, sparse_blocks, vectors
from docmill.plans.shared import spread_table, table


def nearest(found, k=None):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["request"], -r["dense_score"], r["vec_id"])):
        out.setdefault(r["request"], []).append((r["vec_id"], round(r["dense_score"], 5)))
    return out


def clustered(spark, n=1200, groups=12, width=8):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(groups, width)) * 4
    own = centres[np.arange(n) % groups] + rng.normal(size=(n, width)) * 0.2
    return spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(own)], "vec_id long, embedding array<double>, label int").repartition(4)


@pytest.fixture(scope="module")
def asked(spark):
    return table(spark, "/root/testdata/sf0.1", "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("request"), F.col("embedding").alias("asked"))


def test_recall_of_probed_lists(spark, asked):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    index = vectors.temporary(rows, "vec_id", "embedding")
    assert index.probes < len(index.centroids) and index.n.sum() == rows.count()
    true = nearest(retrieval.dense_scores(asked.withColumnRenamed("asked", "embedding"), rows, "request", "vec_id", 15))
    found = nearest(vectors.search(index, asked, "request", "asked", 15))
    assert np.mean([len(set(true[q]) & set(found[q])) / 15 for q in true]) >= 0.9
    few = nearest(vectors.search(index, asked, "request", "asked", 15, probes=3, exact=True))
    assert few == true


def test_files_of_other_lists_are_not_read(spark, capsys):
    rows = clustered(spark)
    index = vectors.temporary(rows, "vec_id", "embedding", lists=24, recall=0.95)
    assert index.probes <= 3
    one = rows.filter("vec_id = 7").select(F.col("vec_id").alias("request"), F.col("embedding").alias("asked"))
    lists = vectors._with_lists(index, one, "request", "asked", 1).first()["lists"]
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(index.rows(lists)) * 6 <= files(index.rows())
    index.rows(lists).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [" in plan and "list#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    again = vectors.read_vectors(spark, index.path)
    true = nearest(retrieval.dense_scores(one.withColumnRenamed("asked", "embedding"), rows, "request", "vec_id", 15))
    for probes, exact in ((None, False), (1, True)):
        assert nearest(vectors.search(again, one, "request", "asked", 15, probes=probes, exact=exact)) == true
    # bounds that few other lists reach: the second round leaves out most
    hits = vectors.search(again, one, "request", "asked", 15, probes=1)
    least = one.join(hits.groupBy("request").agg(F.min("dense_score").alias("least")), "request")
    more = vectors._with_lists(again, least, "request", "asked", 1, "least").first()
    assert more is None or len(more["lists"]) <= 6


def test_many_queries_meet_lists_in_cells(spark, monkeypatch):
    rows = clustered(spark, 600)
    index = vectors.temporary(rows, "vec_id", "embedding", lists=5)
    every = rows.select(F.col("vec_id").alias("request"), F.col("embedding").alias("asked"))
    want = nearest(vectors.search(index, every, "request", "asked", 4, probes=2, exact=True))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 50)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 70)
    assert nearest(vectors.search(index, every, "request", "asked", 4, probes=2, exact=True)) == want
    assert nearest(retrieval.dense_scores(every.withColumnRenamed("asked", "embedding"), rows, "request", "vec_id", 4)) == want


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], "a"), (2, None, "a"), (3, [None, 1.0], "a"), (4, [nan, 1.0], "a"), (5, [inf, 0.0], "a"), (6, [1.0], "a"), (7, [0.0, 0.0], "b"), (8, [1.0, 0.0], "b"), (None, [0.5, 0.5], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, request string")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0, 2.0, 3.0][:1])], "request long, asked array<double>")
    index = vectors.temporary(df, "vec_id", "embedding")
    got = sorted(((r["request"], r["vec_id"], r["dense_score"]) for r in vectors.search(index, queries, "request", "asked", 9, exact=True).collect()), key=str)
    assert got == [(1, 1, 1.0), (1, 7, 0.0), (1, 8, 1.0)]
    kept = vectors.search(index, queries, "request", "asked", 1, keep=F.col("request") == "b").collect()
    assert [(r["request"], r["vec_id"]) for r in kept] == [(1, 8)]
    plain = retrieval.dense_scores(queries.withColumnRenamed("asked", "embedding"), df, "request", "vec_id", 9).collect()
    assert sorted(((r["request"], r["vec_id"], r["dense_score"]) for r in plain), key=str) == got
    empty = vectors.temporary(df.limit(0), "vec_id", "embedding")
    assert vectors.search(empty, queries, "request", "asked", 3, exact=True).count() == 0
    assert vectors.search(index, queries.limit(0), "request", "asked", 3).count() == 0


def hits(found):
    return sorted((r["request"], r["doc_id"], round(r["sparse_score"], 6)) for r in found.collect())


def test_blocks_find_what_all_texts_give(spark, sf):
    docs = spread_table(spark, sf, "documents")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("request"), F.col("text").alias("query"))
    terms = retrieval.tokenised(docs, "doc_id")
    vocab = retrieval.materialise(retrieval.vocabulary(terms), "vocabulary")
    want = hits(retrieval.sparse_topk(asked, terms, vocab, "request", "doc_id", 5))
    index = sparse_blocks.temporary(docs, "doc_id", levels=16, shard_postings=1500)
    assert index.blocks().select("shard").distinct().count() > 16
    again = sparse_blocks.read_blocks(spark, index.path)
    for first in (1, 4):
        assert hits(sparse_blocks.search(again, asked, "request", 5, first=first)) == want


def test_blocks_below_the_bound_are_not_read(spark, sf):
    docs = spread_table(spark, sf, "documents")
    index = sparse_blocks.temporary(docs, "doc_id", levels=16, shard_postings=1500)
    some = docs.filter("n_chars between 100 and 400").select(F.col("doc_id").alias("request"), F.col("text").alias("query"))
    asked = retrieval.materialise(retrieval.postings(some.select("request", retrieval.tokens(F.col("query")).alias("terms")), index.vocabulary(), "request").withColumnRenamed("weight", "asked"), "asked")
    around = sparse_blocks.bounds(index, asked, "request").withColumn("place", F.expr("row_number() over (partition by request order by bound desc, shard)"))
    first = sparse_blocks._scores(index, asked, around.filter("place <= 2"), "request", 1, some.count())
    more = sparse_blocks.remaining(around, first, "request", 1, 2)
    assert 0 < more.count() + around.filter("place <= 2").count() < around.count() / 2


def test_odd_texts(spark, monkeypatch):
    rows = [(1, "alpha beta", "x"), (2, None, "x"), (3, "", "x"), (4, "alpha alpha beta", "x"), (5, "gamma " * 50_000, "x"), (6, "alpha beta", "x"), (7, "+ - !", "x"), (None, "alpha", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, term string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "unknown"), (4, "Gamma")], "request long, query string")
    index = sparse_blocks.temporary(df, "doc_id", levels=2, shard_postings=2)
    want = [(1, 1, 1.0), (1, 4, 1.0), (4, 5, 1.0)]
    assert hits(sparse_blocks.search(index, queries, "request", 2)) == want
    monkeypatch.setattr(sparse_blocks, "QUERY_BLOCK", 1)
    assert hits(sparse_blocks.search(index, queries, "request", 2, first=1)) == want
    assert hits(sparse_blocks.search(index, queries.limit(0), "request", 2)) == []
    with pytest.raises(ValueError):
        sparse_blocks.temporary(df.limit(0), "doc_id")
