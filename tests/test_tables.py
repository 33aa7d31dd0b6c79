"""Bucketed upserts, tables that change together, and approvals on them."""

import os

import pytest
from pyspark.sql import functions as F

from docmill.operators import approval
from docmill.sources import buckets, versions


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def content(spark, path):
    return sorted((r["k"], r["v"]) for r in buckets.read_buckets(spark, path).collect())


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.write_buckets(spark.createDataFrame([(i, f"v{i}") for i in range(500)], "k int, v string"), path, ["k"], 16)
    before = files(path)
    assert len({os.path.dirname(f) for f in before}) == 16
    new = spark.createDataFrame([(3, "new", 1), (3, "newer", 2), (3, "old", 0), (1000, "added", 1)], "k long, v string, at int")
    touched = buckets.upsert_buckets(spark, path, new.select(F.col("k").cast("int").alias("k"), "v", "at"), "at")
    kept = {f for f in before if not any(f"bucket={b}/" in f for b in touched)}
    assert 1 <= len(touched) <= 2 and kept <= files(path) and files(path) & before == kept
    assert content(spark, path) == sorted([(i, f"v{i}") for i in range(500) if i != 3] + [(3, "newer"), (1000, "added")])
    again = buckets.upsert_buckets(spark, path, new.select(F.col("k").cast("int").alias("k"), "v", "at"), "at")  # as after a run that died
    assert again == touched and (3, "newer") in content(spark, path) and len(content(spark, path)) == 501
    few = buckets.read_buckets(spark, path, touched)
    assert 0 < few.count() < 501 and few.select(F.input_file_name()).distinct().count() == len(touched)


def test_deletes_empty_buckets_and_null_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.write_buckets(spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string"), path, ["k"], 64)
    nothing = spark.createDataFrame([], "k int, v string")
    assert len(buckets.upsert_buckets(spark, path, nothing, gone=spark.createDataFrame([(2,), (77,)], "k int"))) == 2
    assert sorted(r["v"] for r in buckets.read_buckets(spark, path).collect()) == ["a", "n"]
    assert buckets.upsert_buckets(spark, path, nothing) == []
    buckets.upsert_buckets(spark, path, spark.createDataFrame([(1, "x")], "k int, v string"), gone=spark.createDataFrame([(1,)], "k int"))
    assert (1, "x") in {(r["k"], r["v"]) for r in buckets.read_buckets(spark, path).collect()}


def numbers(tables, name):
    return sorted(r["id"] for r in tables.read(name).collect())


def test_readers_see_all_of_a_change_or_nothing(spark, tmp_path, monkeypatch):
    tables = versions.TableSet(spark, str(tmp_path / "set"))
    assert tables.names() == []
    with tables.change() as change:
        change.write("a", spark.range(3))
        change.write("b", spark.range(2))
    assert tables.names() == ["a", "b"] and numbers(tables, "a") == [0, 1, 2]
    with pytest.raises(ZeroDivisionError), tables.change() as change:
        change.write("a", spark.range(9))
        assert numbers(tables, "a") == [0, 1, 2]
        raise ZeroDivisionError
    assert numbers(tables, "a") == [0, 1, 2] and tables.clean() == []  # what was written is undone
    monkeypatch.setattr(versions, "release", lambda *a: None)  # a process that is killed undoes nothing
    with pytest.raises(ZeroDivisionError), tables.change() as change:
        change.write("b", spark.range(9))
        raise ZeroDivisionError
    monkeypatch.undo()
    assert numbers(tables, "b") == [0, 1] and len(tables.clean()) == 1
    old = tables.read("a")
    with tables.change() as change:
        change.write("a", tables.read("a").union(spark.range(10, 11)))
    assert numbers(tables, "a") == [0, 1, 2, 10] and old.count() == 3  # a reader that began before the swap
    assert tables.clean() == [] and len(tables.clean(keep_previous=False)) == 1
    assert numbers(versions.TableSet(spark, str(tmp_path / "set")), "b") == [0, 1]


def test_two_changes_at_once_conflict(spark, tmp_path):
    tables = versions.TableSet(spark, str(tmp_path / "set"))
    with pytest.raises(versions.Conflict), tables.change() as late:
        late.write("a", spark.range(1))
        with tables.change() as first:
            first.write("a", spark.range(5))
    assert numbers(tables, "a") == [0, 1, 2, 3, 4] and tables.clean() == []


def test_refresh_keeps_manual_rows_and_needs_rows(spark, tmp_path):
    tables = versions.TableSet(spark, str(tmp_path / "set"))
    assert versions.refresh(tables, "t", spark.range(4), F.col("id") == 0)
    assert not versions.refresh(tables, "t", spark.range(0), F.col("id") == 0) and numbers(tables, "t") == [0, 1, 2, 3]
    assert versions.refresh(tables, "t", spark.range(10, 12), F.col("id") == 0) and numbers(tables, "t") == [0, 10, 11]


def as_of():
    return F.lit("2026-03-04").cast("date")


@pytest.fixture
def submitted(spark, tmp_path):
    data = ['{"question": "Q", "answer": "' + "word " * 100 + '"}', '{"title": "T", "start_date": "2026-05-01"}', '{"title": "", "content": ""}', "{}", None]
    kinds = ["custom_knowledge", "event", "announcement", "other", None]
    items = spark.createDataFrame([(i, k, d, "pending") for i, (k, d) in enumerate(zip(kinds, data, strict=True))], "item_id long, kind string, data string, status string")
    tables = versions.TableSet(spark, str(tmp_path / "set"))
    with tables.change() as change:
        change.write("items", items)
        notices = change.write("notices", approval.notices_of(items.limit(0), as_of()))
        change.write("chunks", approval.chunks_of(notices, 300, 80))
    return tables


def states(tables):
    n = {r["item_id"]: r["n"] for r in tables.read("chunks").groupBy("item_id").agg(F.count("*").alias("n")).collect()}
    noticed = {r["item_id"] for r in tables.read("notices").collect()}
    return {r["item_id"]: (r["status"], n.get(r["item_id"], 0), r["item_id"] in noticed) for r in tables.read("items").collect()}


def test_approve_and_reject(spark, submitted):
    decide = lambda *rows: approval.settle(submitted, spark.createDataFrame(rows, "item_id long, approve boolean"), as_of())
    decide((0, True), (1, True), (2, True), (3, True), (4, True), (99, True), (1, None))
    assert states(submitted) == {0: ("approved", 2, True), 1: ("approved", 1, True), 2: ("pending", 0, False), 3: ("approved_manually", 0, False), 4: ("approved_manually", 0, False)}
    decide((0, True), (1, False), (1, True))
    assert states(submitted)[0] == ("approved", 2, True) and states(submitted)[1] == ("rejected", 0, False)
    decide((1, True))
    assert states(submitted)[1] == ("approved", 1, True)


@pytest.mark.parametrize("step", ["chunks", "notices", "items"])
def test_a_failed_step_leaves_all_as_it_was(spark, submitted, monkeypatch, step):
    before, whole = states(submitted), versions.Change.write

    def write(self, name, rows):
        out = whole(self, name, rows)
        if name == step:
            raise OSError("the index is away")
        return out

    monkeypatch.setattr(versions.Change, "write", write)
    with pytest.raises(OSError):
        approval.settle(submitted, spark.createDataFrame([(0, True)], "item_id long, approve boolean"), as_of())
    assert states(submitted) == before and submitted.clean() == []
