import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.llm import hard_negatives, registry
from docmill.plans.shared import table

KIND = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k=5, low=80, high=100, is_anchor=lambda i: i is not None and i % 100 == 0):
    own = [(i, [math.floor(256 * float(x)) for x in v], c) for i, v, c in rows if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    place = lambda h: (-h[0], h[1] is None, h[1] or 0)
    score = lambda a, b: max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))
    out = []
    for n, (a, v, c) in enumerate(own):
        if not is_anchor(a):
            continue
        hits = [(score(v, w), i, d) for m, (i, w, d) in enumerate(own) if m != n]
        for s, p, _ in sorted((h for h in hits if h[2] == c), key=place)[:k]:
            fit = sorted((h for h in hits if h[2] != c and low * s <= 100 * h[0] <= high * s), key=place)
            out += [(a, p, r, i, s, t) for r, (t, i, _) in enumerate(fit[:k], 1)]
    return sorted(out, key=str)


def mined(df, **options):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r[c] for c in cols) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **options).collect()), key=str)


def test_query_equals_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in table(spark, sf, "embeddings").collect()]
    got = sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in registry.QUERIES["op12_hard_negatives"](spark, sf).collect()), key=str)
    assert got == brute(rows) and got


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    random.seed(3)
    rows = [(i, [random.randint(-2, 4) / 4 for _ in range(3)], i // 10 % 2, "x") for i in range(0, 1200, 10)]  # many ties
    rows += rows[:25]  # repeated rows, anchors among them
    df = spark.createDataFrame(rows, KIND).repartition(4)
    want = brute([r[:3] for r in rows])
    assert want
    for anchors, block in ((4096, 8192), (3, 17), (1, 1000)):
        monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
        monkeypatch.setattr(hard_negatives, "ROWS", block)
        monkeypatch.setattr(hard_negatives, "SCORES", 50)
        assert mined(df) == want


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [nan, 1.0], 1), (400, [inf, 1.0], 1), (500, [1.0, 1.0], None), (None, [1.0, 1.5], 1), (None, [1.0, 1.25], 2), (1, [1.0, 1.0], 1), (2, [0.9, 1.0, 5.0], 2), (3, [], 2), (4, [0.5], 2), (600, [1e30, -1e30], 1), (5, [1e30, 1.0], 2), (6, [-3.0, -4.0], 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], KIND)
    assert mined(df) == brute(rows)
    assert mined(df.filter("vec_id = 0")) == [] == mined(df.limit(0))
    assert mined(df.filter("label = 1")) == []
    assert mined(df.withColumn("embedding", F.expr("transform(embedding, x -> cast(x as double))"))) == brute(rows)


def test_extreme_scores_stay_exact():
    a, b = np.array([[2.0**31, 1.0], [1.0, 1.0], [2.0**80, -1.0]]), np.array([[2.0**31, 1.0], [2.0**80, 3.0], [-3.0, 4.0]])
    got = hard_negatives.inner_products(a, b)
    assert got[0, 0] == 2**62 + 1 and got[0, 1] == 2**63 - 1 == got[2, 1] and got[1, 2] == 1 and got[2, 2] == -(2**63) + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(-3, 3), st.integers(-(2**63) + 1, 2**63 - 1)), min_size=5, max_size=5), min_size=1, max_size=4))
def test_scores_sort_by_score_and_place(lines):
    scores, places = hard_negatives.sorted_scores(np.array(lines, np.int64))
    for line, s, p in zip(lines, scores.tolist(), places.tolist(), strict=True):
        assert p == sorted(range(5), key=lambda i: (-line[i], i)) and s == [line[i] for i in p]
