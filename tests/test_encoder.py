"""The encoder against a dense solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.functions.text import tokens
from docmill.operators import encoder
from docmill.plans.shared import table


def dense(spark, docs, own):
    """TF-IDF rows of all texts as a dense matrix."""
    rows = docs.select("doc_id", tokens(F.col("text")).alias("terms")).orderBy("doc_id").collect()
    place = {t: i for i, t in enumerate(own.terms.to_pylist())}
    out = np.zeros((len(rows), len(place)))
    for i, r in enumerate(rows):
        for t in r["terms"]:
            if t in place:
                out[i, place[t]] = own.idf[place[t]]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def grouped(spark, n=240):
    """Texts of six subjects, so that the first six directions stand out."""
    rng = np.random.default_rng(4)
    words = [[f"w{g}x{i}" for i in range(12)] for g in range(6)]
    return spark.createDataFrame([(i, " ".join(rng.choice(words[i % 6], 6).tolist() + rng.choice(words[(i + 1) % 6], 1).tolist())) for i in range(n)], "doc_id long, text string").repartition(5)


def test_neighbours_equal_those_of_a_dense_solver(spark, monkeypatch):
    docs = grouped(spark)
    own = encoder.fit_encoder(docs, "doc_id", width=6, passes=9)
    x = dense(spark, docs, own)
    exact = np.linalg.svd(x, full_matrices=False)[2][:6].T
    assert np.allclose(own.projection @ own.projection.T, exact @ exact.T, atol=1e-3)  # the same space
    found = np.array([r["embedding"] for r in encoder.encode(own, docs, "doc_id").orderBy("doc_id").collect()])
    want = x @ exact
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(found @ found.T, want @ want.T, atol=1e-3)
    assert (np.argsort(-(found @ found.T).round(3), axis=1, kind="stable")[:, :5] == np.argsort(-(want @ want.T).round(3), axis=1, kind="stable")[:, :5]).mean() > 0.97
    monkeypatch.setattr(encoder, "FAN", 2)  # several levels of sums
    monkeypatch.setattr(encoder, "BLOCK", 7)
    again = encoder.fit_encoder(docs, "doc_id", width=6, passes=9)
    assert np.allclose(again.projection, own.projection, atol=1e-8)


def test_gram_product(spark, sf):
    docs = table(spark, sf, "documents").limit(60)
    own = encoder.fit_encoder(docs, "doc_id", width=8, max_terms=300)
    x = dense(spark, docs, own)
    thin = np.random.default_rng(1).normal(size=(len(own.terms), 3))
    rows = docs.select(tokens(F.col("text")).alias("terms")).repartition(3)
    assert np.allclose(encoder.gram_times(rows, own.terms, own.idf, thin), x.T @ (x @ thin))


def test_odd_texts_roles_and_files(spark, tmp_path):
    own = encoder.fit_encoder(grouped(spark), "doc_id", width=4)
    encoder.write_encoder(own, spark, str(tmp_path))
    again = encoder.read_encoder(spark, str(tmp_path))
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "nothing known"), (4, "query: w0x1 w0x2"), (5, "w0x1 w0x2"), (5, "w0x1 w0x2"), (None, "passage: w0x1 w0x2")], "doc_id long, text string")
    rows = encoder.encode(again, texts, "doc_id").collect()
    got = [r["embedding"] for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))]
    assert got[:3] == [None] * 3 and got[3] == got[4] == got[5] == got[6] and abs(np.linalg.norm(got[3]) - 1) < 1e-9
    with pytest.raises(ValueError):
        encoder.fit_encoder(texts.filter("doc_id = 2"), "doc_id")


def test_gram_products_over_several_blocks_of_rows(spark):
    import pyarrow as pa

    draw = np.random.default_rng(5)
    lists = [[f"t{j}" for j in draw.permutation(40)[: draw.integers(0, 9)]] for _ in range(2 * encoder.AT_ONCE + 90)]
    idf, thin = draw.uniform(1, 3, 30), draw.normal(size=(30, 7))
    dense = np.zeros((len(lists), 30))
    for i, own in enumerate(lists):
        for t in own:
            if int(t[1:]) < 30:  # others aren't known
                dense[i, int(t[1:])] = idf[int(t[1:])]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)
    rows = spark.createDataFrame([(x,) for x in lists], "terms array<string>").coalesce(1)
    assert np.allclose(encoder.gram_times(rows, pa.array([f"t{j}" for j in range(30)]), idf, thin), dense.T @ (dense @ thin))
