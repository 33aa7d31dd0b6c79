"""Packing documents into token sequences by non-negative least squares over a length histogram.

Documents are tokenised and cut where they are read: whole windows, then the rest as one piece.
Only the histogram of piece lengths, of at most ``window`` entries, reaches the driver. There,
combinations of up to three lengths that fill a window are weighed against it by non-negative
least squares; rounded down they give repeat counts, and lengths left over are packed greedily.
A piece then finds its sequence by its length and its number among the pieces of that length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.plans.shared import BROADCAST_ROWS, materialise

#: The pre-tokenisation pattern of byte-level BPE files of this kind (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as \s of that pattern knows it, in runs that are better not left to its look-ahead: it keeps a state per character.
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """The byte-level BPE of a tokenizers JSON file, which tiktoken encodes at four times the speed.

    As in tokenizers, the string of an added token inside a text gets that token's id.
    """

    def __init__(self, file: bytes):
        whole = json.loads(file)
        model, added = whole["model"], {t["content"]: t["id"] for t in whole["added_tokens"]}
        if any(t[flag] for t in whole["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must match as they stand")
        byte = byte_of_character()
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token)}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("the merges must be in the order of their ids")
        for token in added:
            ranks.pop(token.encode(), None)
        self.added = tuple(added)
        self.words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.blanks = tiktoken.Encoding("blanks", pat_str=r"\s+", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        """A long run of white space is encoded by itself: all of it at the end or before an added token, else but for its last character."""
        out, at = [], 0
        for m in LONG_BLANKS.finditer(text):
            end = m.end() - (m.end() < len(text) and not text.startswith(self.added, m.end()))
            out += self.words.encode(text[at : m.start()], allowed_special="all")
            out += self.blanks.encode_ordinary(text[m.start() : end])
            at = end
        return out + self.words.encode(text[at:], allowed_special="all")


@lru_cache(maxsize=2)
def encoder(file: bytes) -> Encoder:
    return Encoder(file)


def cut(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of every row of docs (doc_id, text), with their number among the task's pieces of their length."""
    file = docs.sparkSession.sparkContext.broadcast(open(tokenizer, "rb").read())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(file.value), TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            at, out = [], []
            for i, text in enumerate(b["text"]):
                ids = np.array([*encode.ids(text.as_py() or ""), end_id], "<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    at.append(i)
                    out.append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids), seen[len(piece)], piece.tobytes() if with_ids else None))
                    seen[len(piece)] += 1
            cols = list(zip(*out, strict=True)) or [[]] * 6
            arrays = [b["doc_id"].take(pa.array(at, pa.int32())), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array([task] * len(at), pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth", "task"]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(cols[5], pa.binary())] if with_ids else []), names=names + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, nth long, task long" + ", ids binary" * with_ids)


def combinations_filling(window: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, of positive lengths that add up to window; c = 0 in pairs."""
    b = np.arange(1, window // 2 + 1)
    rows = [np.stack([window - b, b, np.zeros_like(b)], 1)]
    for c in range(1, window // 3 + 1):
        b = np.arange(c, (window - c) // 2 + 1)
        rows.append(np.stack([window - b - c, b, np.full_like(b, c)], 1))
    return np.concatenate(rows)


def solve_nonnegative(combos: np.ndarray, have: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 near the minimum of |uses of each length - have|, by accelerated projected gradients."""
    n, there = len(have), (combos > 0).astype(float)
    use = lambda x: sum(np.bincount(combos[:, k], x * there[:, k], n) for k in range(3))
    back = lambda r: sum(r[combos[:, k]] * there[:, k] for k in range(3))
    v = back(np.ones(n))
    for _ in range(12):  # the largest eigenvalue, for the step
        v = back(use(v / np.linalg.norm(v)))
    step = 1 / (1.05 * np.linalg.norm(v))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(use(y) - have))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x


def plan(histogram: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), which use up the histogram exactly."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    out = [((window,), int(left[window]))] if left[window] else []
    left[window] = 0
    combos = combinations_filling(window)
    combos = combos[((left[combos] > 0) | (combos == 0)).all(1)]
    if len(combos):
        x = solve_nonnegative(combos, left.astype(float))
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 1:
                break
            lengths, each = np.unique(combos[i][combos[i] > 0], return_counts=True)
            if times := min(int(x[i]), int((left[lengths] // each).min())):
                out.append((tuple(int(v) for v in combos[i] if v), times))
                left[lengths] -= each * times
    while len(there := np.flatnonzero(left)):  # each turn uses up a length: at most window turns
        lengths, room, free = [], window, left.copy()
        while len(there := there[(there <= room) & (free[there] > 0)]):
            exact = [v for v in there[::-1] if free[room - v] > (v == room - v)] if lengths and room < window else []
            lengths.append(int(exact[0] if exact else there[-1]))
            free[lengths[-1]] -= 1
            room -= lengths[-1]
        own, each = np.unique(lengths, return_counts=True)
        times = int((left[own] // each).min())
        left[own] -= each * times
        out.append((tuple(lengths), times))
        there = np.flatnonzero(left)
    return out


def slots(packed: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """By length and first number: length, first number, first sequence, offset; each holds for ``times`` pieces."""
    used, first, rows = defaultdict(int), 0, []
    for lengths, times in packed:
        offset = 0
        for v in lengths:
            rows.append((v, used[v], first, offset))
            used[v] += times
            offset += v
        first += times
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def place(pieces: DataFrame, plan: Callable[[dict[int, int]], list[tuple[tuple[int, ...], int]]], keep: list[str] | None = None) -> DataFrame:
    """pieces, a written table, with sequence_id and offset in place of nth and task.

    plan: sequences for a number of pieces of each length. A piece's sequence follows from its
    length and its number among the pieces of that length, in the order of tasks and rows.
    """
    counts = materialise(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths", keep)
    found = counts.groupBy("length").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("tasks")).collect()  # window rows at most
    length, number, sequence, offset = slots(plan({r["length"]: r["n"] for r in found}))
    high = np.int64(1) << 44
    at = length * high + number
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    starts = counts.select("length", "task", before.alias("before"))  # grows with the tasks, so its rows decide the join
    starts = F.broadcast(starts) if sum(r["tasks"] for r in found) <= BROADCAST_ROWS else starts.hint("merge")
    names = [c for c in pieces.columns if c not in ("nth", "task")]
    numbered = pieces.join(starts, ["length", "task"]).select(*names, (F.col("nth") + F.col("before")).alias("nth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, nth = b["length"].to_numpy(), b["nth"].to_numpy()
            i = np.searchsorted(at, own * high + nth, "right") - 1
            more = [pa.array(sequence[i] + nth - number[i]), pa.array(offset[i])]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), *more], names=[*names, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    return numbered.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, with_ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids: little-endian uint32).

    A document is the ids of its text, then end_id; a null text is empty. Repeated rows are packed
    each. Sequence ids are gapless from 0; in a sequence pieces follow without gaps from offset 0.
    An empty table gives no rows; other columns of docs are not read. Ties: pieces of one length are
    taken in the order of tasks and rows. A very long text is encoded as a whole by one task and cut
    into windows.
    """
    pieces = materialise(cut(docs, tokenizer, window, end_id, with_ids), "pieces", keep)
    placed = place(pieces, lambda histogram: plan(histogram, window), keep)
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.select(*order, *(["ids"] if with_ids else []))


def sequences(packed: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_ids) of ``pack(..., with_ids=True)``: array<int> padded to window, except at a power of two.

    Pieces stand in the order of their offsets, which don't tie. No pieces give no rows; each of repeated
    documents' pieces has its own place; other columns than sequence_id, offset and ids are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for parts in b["parts"]:
                ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in parts]).astype(np.int32)
                rows.append((ids if len(ids) & (len(ids) - 1) == 0 else np.pad(ids, (0, window - len(ids)), constant_values=pad_id), len(ids)))
            yield pd.DataFrame({"sequence_id": b["sequence_id"], "ids": [r[0] for r in rows], "n_ids": [r[1] for r in rows]})

    # a sequence holds window ids at most
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.mapInPandas(run, "sequence_id long, ids array<int>, n_ids long")
