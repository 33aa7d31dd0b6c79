"""The data source over stored list pages."""

import shutil
from pathlib import Path

import pytest

from docmill.sources import boards


def item(n, day="2026.03.01", pinned=False, title=None):
    return f"<li><a onclick='goDetail({n})'><div class=mark>{'<span class=fix>x</span>' * pinned}</div><em>c</em><p class=tit>{title or f'T {n}'}</p><span>{day}.</span><span>7</span></a></li>"


def store(root, board, page, items, file="part-0.txt"):
    folder = Path(root, f"board={board}", f"page={page}")
    folder.mkdir(parents=True, exist_ok=True)
    (folder / file).write_text("<ul>" + "\n".join(items) + "</ul>")


@pytest.fixture
def root(spark, tmp_path):
    spark.dataSource.register(boards.BoardSource)
    store(tmp_path, "a", 0, [item(9, pinned=True), item(30), item(29)])
    store(tmp_path, "a", 1, [item(9, pinned=True), item(28, "2026.02.30"), item(0, "x")])
    store(tmp_path, "b%20%2F", 10, [item(5, title="A &amp; <b>B</b>")])
    store(tmp_path, "b%20%2F", 9, [item(6)])
    store(tmp_path, "empty", 0, [])
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "board=a" / "notes.txt").write_text(item(99))
    return str(tmp_path)


def test_batch_reads_every_item_in_partitions(spark, root):
    df = spark.read.format("board_pages").option("pagesPerTask", 1).load(root)
    assert df.rdd.getNumPartitions() == 5
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [
        ("a", 0, 0, 9, "T 9", "c", "2026-03-01", True), ("a", 0, 1, 30, "T 30", "c", "2026-03-01", False), ("a", 0, 2, 29, "T 29", "c", "2026-03-01", False),
        ("a", 1, 0, 9, "T 9", "c", "2026-03-01", True), ("a", 1, 1, 28, "T 28", "c", None, False), ("a", 1, 2, 0, "T 0", "c", None, False),
        ("b /", 9, 0, 6, "T 6", "c", "2026-03-01", False), ("b /", 10, 0, 5, "A & B", "c", "2026-03-01", False),
    ]
    known = spark.read.format("board_pages").option("known", '{"a": 28, "b /": 9}').load(root).collect()
    assert sorted(r["article_id"] for r in known) == [29, 30]


def test_empty_folder(spark, root, tmp_path):
    assert spark.read.format("board_pages").load(str(tmp_path / "board=empty")).count() == 0
    assert spark.read.format("board_pages").load(str(tmp_path / "missing")).count() == 0


def follow(spark, root, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    run = spark.readStream.format("board_pages").load(root).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return sorted((r["board"], r["article_id"]) for r in spark.read.parquet(out).collect())


def test_a_restart_gives_no_item_twice(spark, root, tmp_path_factory):
    work = tmp_path_factory.mktemp("stream")
    first = [("a", 0), ("a", 9), ("a", 28), ("a", 29), ("a", 30), ("b /", 5), ("b /", 6)]
    assert follow(spark, root, work) == first
    assert follow(spark, root, work) == first
    # two new items push the others down, a new board comes
    store(root, "a", 0, [item(9, pinned=True), item(32), item(31), item(30)])
    store(root, "a", 1, [item(9, pinned=True), item(29), item(28)])
    store(root, "c", 0, [item(1)])
    assert follow(spark, root, work) == sorted([*first, ("a", 31), ("a", 32), ("c", 1)])


def test_an_interrupted_batch_is_given_again(spark, root, tmp_path_factory):
    work = tmp_path_factory.mktemp("stream")

    def run():
        write = lambda df, n: df.write.mode("overwrite").parquet(f"{work}/out/batch={n}")
        spark.readStream.format("board_pages").load(root).writeStream.foreachBatch(write).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["board"], r["article_id"], r["batch"]) for r in spark.read.parquet(f"{work}/out").collect())

    run()
    store(root, "a", 0, [item(40), item(30)])
    want = run()
    commits = Path(work, "checkpoint", "commits")
    last = max(int(p.name) for p in commits.glob("[0-9]*"))
    for name in (str(last), f".{last}.crc"):  # as if the driver had died before the commit
        (commits / name).unlink(missing_ok=True)
    store(root, "a", 0, [item(41), item(40), item(30)])  # and a later item came
    shutil.rmtree(work / "out" / f"batch={last}")
    assert run() == want  # the same range of ids
    assert run() == sorted([*want, ("a", 41, last + 1)])


def test_only_changed_pages_are_read_again(root, monkeypatch):
    read, whole = [], boards.items_of
    monkeypatch.setattr(boards, "items_of", lambda path, board, pages: (read.extend(p[0] for p in pages), whole(path, board, pages))[1])
    stream = boards.BoardStream({"path": root})
    start = stream.latestOffset()
    assert start == {"a": 30, "b /": 6} and len(read) == 5
    store(root, "a", 0, [item(33), item(30)], "part-1.txt")
    read.clear()
    end = stream.latestOffset()
    assert end == {"a": 33, "b /": 6} and read == [0]
    parts = stream.partitions(start, end)
    assert [(p.board, len(p.pages), p.low, p.high) for p in parts] == [("a", 1, 30, 33)]
    assert [r[3] for r in stream.read(parts[0])] == [33]
    assert list(stream.read(stream.partitions(end, end)[0])) == []
