"""Exact dedup, mixing, site lines and line quality on small tables with edge cases."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from docmill.llm import exact_dedup, line_quality, mixing, site_lines

SCHEMA = "doc_id long, text string, source string, kept int, size string"
LONG = "".join(np.random.default_rng(0).choice(list("abcdefgh \n"), 50_000))
ROWS = [
    (1, "a b", "s", 0, "x"), (2, "ab", "s", 0, "x"), (3, "a  b", "t", 0, "x"), (4, None, "s", 0, "x"), (5, "", None, 0, "x"), (6, " \n", None, 0, "x"),
    (7, LONG, "s", 0, "x"), (8, LONG.replace(" ", "\t"), "s", 0, "x"), (9, LONG + "z", "s", 0, "x"), (10, LONG[:-1] + "q", "s", 0, "x"),
    (11, "dup", "s", 0, "x"), (11, "dup", "s", 0, "x"), (None, "dup", "s", None, None), (None, None, None, None, None),
]


def norm(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def brute_groups(rows):
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(norm(r[1]), []).append(((-len(r[1] or ""), r[0] is None, r[0] or 0), i))
    out = []
    for i, r in enumerate(rows):
        own = groups[norm(r[1])]
        first = min(own)
        out.append((r[0], rows[first[1]][0], len(own), hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    return sorted(out, key=str), sorted((rows[min(g)[1]][0] for g in groups.values()), key=str)


def test_exact_dedup(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    want, kept = brute_groups(ROWS)
    for size in (4096, 1000, 3):
        got = exact_dedup.exact_groups(df, size).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
        assert sorted((r.doc_id for r in got if r.kept), key=str) == kept
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns and sorted((r.doc_id for r in left.collect()), key=str) == kept
    assert exact_dedup.exact_groups(df.filter("doc_id > 99")).count() == 0 and exact_dedup.drop_copies(df.filter("doc_id > 99")).count() == 0


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(w[s] for s in free) if free else 0
        above = {s for s in free if level * w[s] >= most * sizes[s]}
        if not above:
            return target | {s: level * w[s] for s in free}
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
            free.discard(s)


def test_mixing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(1, 90)), f"s{int(rng.integers(0, 9)) ** 2 % 11}") for i in range(3000)] + [(5000, None, None), (5001, "a b c", None), (5002, "", "zz"), (5002, "", "zz")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, copies int, target string")
    got = mixing.mix(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = brute_targets(sizes), {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 0.12 * want[s] + 150 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    out = mixing.emit(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(df.filter("doc_id > 9999")).count() == mixing.emit(df.filter("doc_id > 9999")).count() == 0
    empty = mixing.mix(df.filter("text = '' or text is null"))
    assert [(r.size, r.target, r.copies) for r in empty.collect()] == [(0, 0.0, 0)] * 3


def test_site_lines(spark):
    rows = [(i, f"Shared  Line\nown line {i}\n\nend", "a", 1, "x") for i in range(20)] + [(50 + i, f"page {i}", "a", 1, "x") for i in range(20)]
    rows += [(100, None, "a", 1, "x"), (101, "", None, 1, "x"), (102, "shared line", "b", 1, "x"), (103, "z\n" * 9000, "b", 1, "x"), (None, "shared line\nq", "a", None, None), (None, "shared line\nq", "a", None, None)]
    got = site_lines.drop_site_lines(spark.createDataFrame(rows, SCHEMA))
    by = {r.doc_id: r for r in got.collect()}
    assert by[3].text == "own line 3\n" and (by[3].n_lines, by[3].n_dropped, by[3].host_pages) == (4, 2, 43)
    assert by[55].text == "page 5" and by[100].text is None and by[101].text == "" and by[102].text == "shared line" and by[103].n_dropped == 0
    assert by[None].text == "q" and got.count() == len(rows)
    assert site_lines.drop_site_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_quality(spark):
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"Common LINE here\n{words(i)}", "a", 1, "x") for i in range(30)]
    rows += [(100 + i, "common line  here\n" * 30 + "only this", "a", 1, "x") for i in range(3)]
    rows += [(200 + i, f"{words(999)}\nsecond {words(998)}", "copies", 1, "x") for i in range(40)]
    rows += [(300, None, "a", 1, "x"), (301, "", None, 1, "x"), (302, "a b c " * 40, "a", 1, "x"), (303, "x|y #1 <b>\nx|y #1 <b>", "b", 1, "x"), (None, words(5000), None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    by = {r.doc_id: r for r in line_quality.judge(df).collect()}
    assert by[0].kept and by[0].removed_words == 0 and by[0].cleaned == rows[0][1]  # the first document keeps the line
    assert by[5].kept and by[5].removed_words == 3 and by[5].cleaned == words(5)
    assert not by[100].kept and by[100].removed_words == 90 and by[100].base_failed
    assert all(by[200 + i].kept and by[200 + i].removed_words == 0 for i in range(40))
    assert (by[300].n_words, by[300].kept, by[300].cleaned) == (0, False, None) and by[302].base_failed and by[302].n_repeat_words == 120
    assert (by[303].n_symbols, by[303].n_dup_lines, by[303].n_words, by[303].word_chars) == (8, 1, 6, 16) and by[None].kept
    out = line_quality.keep_good(df.withColumn("n_chars", F.length("text").cast("long")))
    assert out.columns == [*df.columns, "n_chars"]
    assert {r.doc_id for r in out.collect()} == {*range(30), *range(200, 240), None}
    assert line_quality.judge(df.filter("doc_id > 9999")).count() == 0 and line_quality.keep_good(df.filter("doc_id > 9999")).count() == 0


def test_windows_of_long_texts_are_counted_alike(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [[b"w%d" % i for i in rng.integers(0, v, n)] for n, v in ((3, 2), (50, 4), (200, 9), (500, 30), (90_000, 60)) for _ in range(3)]
    want = [line_quality.repeat_words(t) for t in texts]
    monkeypatch.setattr(line_quality, "LONG_TEXT", 3)
    assert [line_quality.repeat_words(t) for t in texts] == want
    monkeypatch.setattr(line_quality, "LONG_TEXT", 10**9)
    assert [line_quality.repeat_words(t) for t in texts] == want and want[-1] > 0
