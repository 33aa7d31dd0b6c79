"""Paths of deep, broken and circular trees; windows of very long texts."""

import time

import pytest
from pyspark.sql import functions as F

from docmill.operators import chunks, trees

KIND = "id string, parent string, name string, path string"


def found(spark, nodes):
    df = spark.createDataFrame([(*n, "x") for n in nodes], KIND).repartition(3)
    return {r["id"]: r["path"] for r in trees.paths(df).collect()}


def test_depth_fifty(spark):
    nodes = [(f"n{i}", f"n{i - 1}" if i else None, f"name {i}") for i in range(50)]
    assert found(spark, nodes) == {f"n{i}": " > ".join(f"name {k}" for k in range(i + 1)) for i in range(50)}


def test_rounds_grow_as_the_logarithm_of_the_depth(spark, monkeypatch):
    written, whole = [], trees.materialise
    monkeypatch.setattr(trees, "materialise", lambda *a: written.append(a[1]) or whole(*a))
    assert len(found(spark, [(str(i), str(i - 1) if i else "#", str(i)) for i in range(100)])) == 100
    assert len(written) <= 9


def test_cycles_orphans_blank_names(spark):
    nodes = [("a", None, " A "), ("b", "a", "B"), ("c", "missing", "C"), ("d", "c", None), ("e", "d", "E"), ("x", "z", "X"), ("y", "x", "Y"), ("z", "y", "Z"), ("w", "z", "W"), ("s", "s", "S"), ("t", "Top", "T"), (None, "a", "gone"), ("u", " ", "")]
    assert found(spark, nodes) == {"a": "A", "b": "A > B", "c": "C", "d": "C", "e": "C > E", "x": None, "y": None, "z": None, "w": None, "s": None, "t": "T", "u": ""}
    assert found(spark, []) == {}


def test_a_third_below_one_node(spark):
    nodes = [("r", None, "R")] + [(str(i), "r" if i % 3 else str(i // 3 + 1), str(i)) for i in range(1, 400)]
    got = found(spark, nodes)
    assert got["2"] == "R > 2" and got["6"] == "R > 2 > 3 > 6" and len(got) == 400


@pytest.mark.parametrize("size,overlap", [(300, 80), (7, 3), (5, 0), (4, 9), (10, 1)])
def test_windows_are_substrings(spark, size, overlap):
    texts = ["", "a", "x" * size, "é🙂\n漢" * 50, "ab\r\n" * 33 + "end"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunks.windows(F.col("t"), size, overlap).alias("w"))
    step = max(1, size - overlap)
    for r in df.collect():
        n = max(1, -(-(len(r["t"]) - size) // step) + 1)
        assert r["w"] == ([r["t"][i * step : i * step + size] for i in range(n)] if r["t"] else [""])


def test_windows_of_a_long_text_take_linear_time(spark):
    took = []
    for n in (1_000_000, 10_000_000):
        df = spark.range(1).select(F.repeat(F.lit("word and "), n // 9).alias("t"))
        began = time.perf_counter()
        assert df.select(F.explode(chunks.windows(F.col("t"), 300, 80))).count() > n // 250
        took.append(time.perf_counter() - began)
    assert took[1] < 30
