"""Best-fit packing after a Martello-Toth dominance reduction, over a histogram of document lengths.

Documents are tokenised where they are read; only those longer than a window are cut. The number of
pieces of each length, ``window`` numbers at most, reaches the driver. There small sets of lengths
that provably dominate every other set with their longest piece are fixed for good, which shrinks
the instance, and the rest is packed best-fit, longest first. Both work on lengths with counts: a
step places all pieces of a length that are treated alike, so its work doesn't grow with the table.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docmill.llm.packing import byte_of_character, place
from docmill.plans.shared import materialise

#: Characters of a text that are encoded at once, about; longest word and most words that a task remembers.
SLICE, WORD, WORDS = 1 << 20, 64, 300_000
BLANKS = " \t\n\r\x0b\x0c"
#: Printable ASCII and Latin letters, which Unicode rules leave as they are but for their case; the parts that the tokenizer encodes by themselves (fixed value).
PLAIN, ODD = re.compile("[!-~À-ÖØ-öø-įı-ňŊ-ž]+"), re.compile(f"[^!-~À-ÖØ-öø-įı-ňŊ-ž{BLANKS}]")
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-z0-9ß-öø-ž{BLANKS}]+")
SPACES = re.compile(f"[{BLANKS}]+")
#: Stands for the end of a part; no plain word has it.
END = "\x01"


class WordEncoder:
    """Ids of texts, as tokenizers gives them.

    The tokenizer drops white space, and no rule of it looks beyond: a text's ids are its words' ids in
    turn. tiktoken encodes runs of plain words, at several times the speed; words with other characters
    go through tokenizers, and their ids are remembered. The memory is emptied when it is full.
    """

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_buffer(file), {}
        whole = json.loads(file)
        model, added = whole["model"], {t["content"] for t in whole["added_tokens"]}
        byte, last = byte_of_character(), model["end_of_word_suffix"]
        as_bytes = lambda t: bytes(byte[c] for c in t.removesuffix(last)) + END.encode() * t.endswith(last)
        ranks = {as_bytes(t): i for t, i in model["vocab"].items() if t not in added}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged) or len(ranks) + len(added & model["vocab"].keys()) != len(model["vocab"]):
            raise ValueError("the merges must be in the order of their ids, and no token may hold the mark of an end")
        self.bpe = tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})
        self.added = tuple(added)

    def _slices(self, text: str) -> Iterator[str]:
        """Parts of about SLICE characters that end at white space, or more where there is none."""
        at = 0
        while len(text) - at > SLICE:
            ends = [e for e in (text.find(c, at + SLICE) for c in BLANKS) if e >= 0]
            if not ends:
                break
            yield text[at : min(ends)]
            at = min(ends)
        yield text[at:]

    def _plain(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(END.join([*PARTS.findall(text.lower()), ""])), "<u4").tobytes()

    def _other(self, words: list[str]) -> Iterator[bytes]:
        if len(self.known) > WORDS:
            self.known.clear()
        new = list(set(words).difference(self.known))
        got = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(new, got, strict=True))
        yield from map(self.known.__getitem__, words)
        for w in new:
            if len(w) > WORD:
                del self.known[w]

    def ids(self, text: str) -> np.ndarray:
        """Little-endian uint32 ids of a text."""
        out = []
        for part in self._slices(text):
            marked = any(a in part for a in self.added)
            if not marked and not ODD.search(part):
                out.append(self._plain(part))
                continue
            whole = lambda w: PLAIN.fullmatch(w) is not None and not (marked and any(a in w for a in self.added))  # noqa: B023, E731
            for plain, words in groupby((w for w in SPACES.split(part) if w), whole):
                out += [self._plain(" ".join(words))] if plain else self._other(list(words))
        return np.frombuffer(b"".join(out), "<u4")


@lru_cache(maxsize=2)
def word_encoder(file: bytes) -> WordEncoder:
    return WordEncoder(file)


def cut(docs: DataFrame, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """Pieces of every row of docs (doc_id, text), with their number among the task's pieces of their length."""
    file = docs.sparkSession.sparkContext.broadcast(open(tokenizer, "rb").read())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = word_encoder(file.value), TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            at, out = [], []
            for i, text in enumerate(b["text"]):
                ids = np.append(encode.ids(text.as_py() or ""), np.array([end_id], "<u4"))
                for k, start in enumerate(range(0, len(ids), window)):
                    piece = ids[start : start + window]
                    at.append(i)
                    out.append((k, start, len(piece), zlib.crc32(piece.tobytes()), seen[len(piece)]))
                    seen[len(piece)] += 1
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int32(), *[pa.int64()] * 4]
            arrays = [b["doc_id"].take(pa.array(at, pa.int32())), *map(pa.array, cols, kinds), pa.array([task] * len(at), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, nth long, task long")


def _best_pair(lengths: np.ndarray, n: np.ndarray, room: int) -> tuple[int, int]:
    """The pair a >= b of pieces that fills room best, the larger a of equals; lengths ascend, n counts them, some pair fits."""
    a = lengths[: np.searchsorted(lengths, room, "right")]
    i = np.searchsorted(lengths, np.minimum(a, room - a), "right") - 1
    i = i - ((i >= 0) & (lengths[i] == a) & (n[i] < 2))
    sums = np.where(i >= 0, a + lengths[i], -1)
    k = len(sums) - 1 - int(np.argmax(sums[::-1]))
    return int(a[k]), int(lengths[i[k]])


def dominating(left: np.ndarray, v: int) -> tuple[int, ...] | None:
    """A set of pieces with one of length v that dominates every feasible set with it, if a small one is known to.

    left counts the pieces by length up to the window. The best pieces beside v are looked for
    among the others: none fits; one fills the window; or only one, or two, can stand beside v,
    and the largest, or the fullest pair, can take the place of whatever else would stand there.
    """
    room, n = len(left) - 1 - v, left.copy()
    n[v] -= 1
    lengths = np.flatnonzero(n)
    n = n[lengths]
    fit = int(np.searchsorted(lengths, room, "right"))
    if not fit:
        return (v,)
    largest = int(lengths[fit - 1])
    least = [int(x) for x, k in zip(lengths[:3], n[:3], strict=True) for _ in range(min(k, 3))][:3]
    if largest == room or sum(least[:2]) > room or len(least) < 2:
        return (v, largest)
    if len(least) == 3 and sum(least) <= room:
        return None
    a, b = _best_pair(lengths, n, room)
    if largest >= a + b:
        return (v, largest)
    between = [int(x) for x, k in zip(lengths, n, strict=True) if b < x < a for _ in range(min(k, 2))][:2]
    return (v, a, b) if largest == a and (len(between) < 2 or sum(between) > room) else None


def reduce(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Take dominating sets out of left until there is none: (lengths, how many such sets).

    A set that dominates does so again while its pieces last: fewer others leave it fewer rivals.
    """
    out, before = [], -1
    while before != len(out):
        before = len(out)
        for v in np.flatnonzero(left)[::-1]:
            while left[v] and (lengths := dominating(left, int(v))):
                own, each = np.unique(lengths, return_counts=True)
                times = int((left[own] // each).min())
                left[own] -= each * times
                out.append((lengths, times))
    return out


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of what left counts: (lengths, how many such sequences).

    The fullest sequence that a piece fits into stays the fullest for the next piece of its length,
    so all sequences of one content fill up alike, and a length splits two contents at most.
    """
    window = len(left) - 1
    filled: dict[int, list[list]] = defaultdict(list)  # room: [content, times]
    rooms = np.zeros(window + 1, bool)

    def add(room: int, content: tuple, times: int) -> None:
        filled[room].append([content, times])
        rooms[room] = True

    for v in np.flatnonzero(left)[::-1].tolist():
        n = int(left[v])
        while n:
            room = v + int(np.argmax(rooms[v:])) if rooms[v:].any() else 0
            content, there = filled[room][-1] if room else ((), n)
            each = (room or window) // v
            times, more = min(there, n // each), 0
            if times:
                add((room or window) - each * v, (*content, (v, each)), times)
            if times < there and 0 < (n - times * each) < each:
                more = n - times * each
                add((room or window) - more * v, (*content, (v, more)), 1)
            n -= times * each + more
            if room:
                own = next(x for x in filled[room] if x[0] is content)
                own[1] -= times + (more > 0)
                if not own[1]:
                    filled[room].remove(own)
                    rooms[room] = bool(filled[room])
    left[:] = 0
    return [(tuple(v for v, n in content for _ in range(n)), times) for room in sorted(filled) for content, times in filled[room]]


def plan(histogram: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), which use up the histogram exactly."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    return reduce(left) + best_fit(left)


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 1, keep: list[str] | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text, then end_id; a null text is empty. Repeated rows are packed
    each. Only documents longer than window are cut, at whole windows. Sequence ids are gapless from
    0; in a sequence pieces follow without gaps from offset 0. An empty table gives no rows; other
    columns of docs are not read. Ties: pieces of one length are taken in the order of tasks and rows.
    """
    pieces = materialise(cut(docs, tokenizer, window, end_id), "pieces", keep)
    return place(pieces, lambda histogram: plan(histogram, window), keep)
