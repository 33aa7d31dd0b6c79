import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docmill.llm import best_fit, registry
from docmill.plans.shared import table

FILE = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(FILE)


@lru_cache(maxsize=None)
def fewest(lengths, window):
    """The least number of windows, by trying all sets with the longest piece."""
    if not lengths:
        return 0
    rest, best = lengths[1:], len(lengths)

    def fill(i, room, left):
        nonlocal best
        best = min(best, 1 + fewest(left, window))
        for j in range(i, len(left)):
            if left[j] <= room and (j == i or left[j] != left[j - 1]):
                fill(j, room - left[j], left[:j] + left[j + 1 :])

    fill(0, window - lengths[0], rest)
    return best


def counted(lengths, window):
    return np.bincount(lengths, minlength=window + 1).astype(np.int64)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_the_optimum(lengths):
    left = counted(lengths, 20)
    fixed = best_fit.reduce(left)
    rest = tuple(sorted(np.repeat(np.arange(21), left).tolist(), reverse=True))
    assert sorted([v for s, n in fixed for v in s * n] + list(rest)) == sorted(lengths)
    assert all(sum(s) <= 20 for s, _ in fixed)
    assert sum(n for _, n in fixed) + fewest(rest, 20) == fewest(tuple(sorted(lengths, reverse=True)), 20)


def one_by_one(lengths, window):
    """Best-fit decreasing, piece by piece: the rooms left."""
    rooms = []
    for v in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= v]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else window) - v)
    return sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_counts_fill_up_as_pieces_one_by_one(lengths):
    packed = best_fit.best_fit(counted(lengths, 30))
    assert sorted(v for s, n in packed for v in s * n) == sorted(lengths)
    assert sorted(30 - sum(s) for s, n in packed for _ in range(n)) == one_by_one(lengths, 30)


def test_a_third_alike_and_large_counts():
    packed = best_fit.plan({10: 10**9, 7: 3 * 10**9, 3: 10**9, 1: 5}, 13)
    used = {}
    for lengths, times in packed:
        assert sum(lengths) <= 13
        for v in lengths:
            used[v] = used.get(v, 0) + times
    assert used == {10: 10**9, 7: 3 * 10**9, 3: 10**9, 1: 5}
    assert sum(t for _, t in packed) == 4 * 10**9


WORDS = st.text(st.one_of(st.sampled_from(" \t\n\x0b\x0c\r\x1c\x85\xa0 　aAzÉéİΣςß'sS1٣<|>endoftext́가각漢🙂-_."), st.characters(exclude_categories=("Cs",))), max_size=40)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_ids_are_those_of_the_tokenizer(a, b):
    own = best_fit.word_encoder(open(FILE, "rb").read())
    for text in (a, f"{a} {b}", a + "<|endoftext|>" + b, "Don't́ STOP'S " + a):
        assert own.ids(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_long_texts_go_in_slices(monkeypatch):
    monkeypatch.setattr(best_fit, "SLICE", 50)
    monkeypatch.setattr(best_fit, "WORDS", 10)
    own = best_fit.WordEncoder(open(FILE, "rb").read())
    for text in ("word " * 100, "x" * 500, "ab cd\n" * 40 + "y" * 200 + " end", " " * 300, "漢字 ab “c” " * 50 + "漢" * 99):
        assert own.ids(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def checked(docs, packed, window=4096):
    """Every id of every row once, whole where it fits, no gaps in sequences."""
    by_doc, by_sequence = {}, {}
    for r in packed:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(map(str, by_doc)) == sorted(map(str, {d for d, _ in docs}))
    for doc, text in docs:
        ids = np.array([*WHOLE.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(k, s, len(ids[s : s + window]), zlib.crc32(ids[s : s + window].tobytes())) for k, s in enumerate(range(0, len(ids), window))]
        got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc])
        assert set(want) <= set(got)
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_query_places_every_piece(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    packed = registry.QUERIES["op11_best_fit"](spark, sf).collect()
    checked(docs, packed)
    total = sum(r["length"] for r in packed)
    assert len({r["sequence_id"] for r in packed}) == -(-total // 4096)


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "null id", "c"), (3, "long word " * 6000, "d"), (4, "x" * 30_000, "e"), (5, "same", "f"), (5, "same", "g"), (6, " \n\t ", "h")]
    random.seed(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(3)
    packed = best_fit.pack(docs, FILE).collect()
    checked([r[:2] for r in rows], packed)
    assert sum(r["doc_id"] == 5 for r in packed) == 2
    assert best_fit.pack(docs.limit(0), FILE).count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_longest_pieces_stand_alone(n):
    assert best_fit.plan({4096: n}, 4096) == [((4096,), n)]
    assert best_fit.plan({}, 4096) == []
