import numpy as np
from pyspark.sql import functions as F

from docmill.operators import retrieval
from docmill.plans.shared import materialise, table


def test_grid_and_single_block_agree_with_all_pairs(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    terms = retrieval.tokenised(docs, "doc_id")
    vocab = materialise(retrieval.vocabulary(terms, 200), "vocabulary")
    asked = docs.filter("doc_id % 4 = 0").select(F.concat(F.lit("q"), "doc_id").alias("request"), F.substring("text", 1, 300).alias("query"))
    asked = asked.unionByName(spark.createDataFrame([("none", "zzzz"), ("null", None)], "request string, query string"))
    index = materialise(retrieval.postings(terms, vocab, "doc_id"), "postings")
    want = retrieval.ranked(retrieval.sparse_scores(asked, vocab, index, "request", "doc_id"), "request", "sparse_score", "doc_id", 3).drop("rank")
    want = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, retrieval.sparse_topk(asked, terms, vocab, "request", "doc_id", 3).collect())) == want
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 10)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 60)
    monkeypatch.setattr(retrieval._Scorer, "CELLS", 500)
    assert sorted(map(tuple, retrieval.sparse_topk(asked, terms, vocab, "request", "doc_id", 3).collect())) == want


def test_dense_grid_equals_numpy(spark, monkeypatch):
    rng = np.random.default_rng(0)
    m = np.sign(rng.normal(size=(300, 8))) / 8**0.5  # many ties
    rows = spark.createDataFrame([(f"k{i:03d}", x.tolist()) for i, x in enumerate(m)], "id string, embedding array<float>").repartition(3)
    asked = rows.filter("id < 'k040'").select(F.col("id").alias("request"), "embedding")
    scores = (m.astype("float32").astype(float)[:40] @ m.astype("float32").astype(float).T).round(6)
    want = sorted((f"k{q:03d}", f"k{i:03d}", scores[q, i]) for q in range(40) for i in np.lexsort((np.arange(300), -scores[q]))[:7])
    assert sorted(map(tuple, retrieval.dense_scores(asked, rows, "request", "id", 7).collect())) == want
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 9)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 50)
    assert sorted(map(tuple, retrieval.dense_scores(asked, rows, "request", "id", 7).collect())) == want
    assert retrieval.dense_scores(asked, rows.filter("id = ''"), "request", "id", 7).count() == 0
    assert retrieval.dense_scores(asked.filter("request = ''"), rows, "request", "id", 7).count() == 0
