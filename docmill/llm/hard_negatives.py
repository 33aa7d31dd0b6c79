"""Hard negatives by a full sort of each anchor's integer scores.

Anchors meet all rows in a grid of blocks: a task gets a block of anchors and a block of rows, so
neither is gathered anywhere whole. In a cell the rows are in the order of their ids; a stable sort
of an anchor's scores then orders them by score and id. A first pass over the grid finds each
anchor's positives; a second one binary-searches each positive's upper limit among the sorted scores
of rows of other labels and reads on from there while scores are above the lower limit. A cell passes
on k rows per anchor, or per positive, and windows merge the cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.plans.shared import materialise

#: Anchors and rows of a cell, at most; bytes of a cell's vectors as doubles; scores held at once.
ANCHORS, ROWS, BYTES, SCORES = 4096, 8192, 1 << 26, 1 << 21
_LEAST, _MOST = -(2**63) + 1, 2**63 - 1


def _vectors(lists: pa.ChunkedArray, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of each component, as doubles; shorter vectors end in zeros."""
    lists = lists.combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(int)
    out = np.zeros((len(size), width))
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = np.floor(scale * values)
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered doubles, each row of a with each of b; a sum beyond a long is the nearest long.

    Doubles add up exactly below 2**53. Vectors with larger components go by Python's integers.
    """
    limit = (2**53 / max(1, a.shape[1])) ** 0.5
    large_a, large_b = (np.abs(x).max(axis=1, initial=0) >= limit for x in (a, b))
    out = np.zeros((len(a), len(b)), np.int64)
    if not large_a.any() and not large_b.any():
        return (a @ b.T).astype(np.int64)
    out[np.ix_(~large_a, ~large_b)] = (a[~large_a] @ b[~large_b].T).astype(np.int64)
    whole = lambda x: [list(map(int, r)) for r in x.tolist()]
    exact = lambda x, y: min(_MOST, max(_LEAST, sum(p * q for p, q in zip(x, y, strict=True))))
    rows = whole(b)
    for i, x in enumerate(whole(a)):
        for j in range(len(b)) if large_a[i] else np.flatnonzero(large_b):
            out[i, j] = exact(x, rows[j])
    return out


def sorted_scores(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, places) of each row, larger scores first, equal ones by place."""
    if not scores.size:
        return scores, np.zeros(scores.shape, np.int64)
    n, high, low = scores.shape[1], int(scores.max()), int(scores.min())
    bits = max(1, (n - 1).bit_length())
    if high - low < 1 << (62 - bits):  # score and place in one number: one plain sort
        packed = ((high - scores) << bits) + np.arange(n)
        packed.sort(axis=1)
        return high - (packed >> bits), packed & ((1 << bits) - 1)
    order = np.argsort(-scores, axis=1, kind="stable")
    return np.take_along_axis(scores, order, 1), order


class _Cell:
    """A block of rows in the order of their ids (null last), and a block of anchors."""

    def __init__(self, rows: pa.Table, anchors: pa.Table, scale: int, width: int):
        rows = rows.take(pc.sort_indices(rows["id"], null_placement="at_end"))
        self.ids, self.labels, self.rows = rows["id"].combine_chunks(), rows["label"].to_numpy(), _vectors(rows["vector"], scale, width)
        self.anchors, self.anchor_labels, self.queries = anchors, anchors["label"].to_numpy(), _vectors(anchors["vector"], scale, width)
        self.scale, self.width = scale, width

    def sorted(self, same: bool):
        """(anchors, scores, places) of anchors of one label and the rows of the same label, or of others, in slices."""
        for label in dict.fromkeys(self.anchor_labels):
            mine, rows = np.flatnonzero(self.anchor_labels == label), np.flatnonzero((self.labels == label) == same)
            step = max(1, SCORES // max(1, len(rows)))
            for a in range(0, len(mine) if len(rows) else 0, step):
                own = mine[a : a + step]
                scores, places = sorted_scores(inner_products(self.queries[own], self.rows[rows]))
                yield own, scores, rows[places]


def _positives(rows: pa.Table, anchors: pa.Table, scale: int, width: int, k: int) -> pa.Table:
    """The first k rows of each anchor's label. own: the row is the anchor itself or can't be told from it."""
    cell, own_ids = _Cell(rows, anchors, scale, width), anchors["id"].combine_chunks()
    anchor, place, score = [], [], []
    for own, scores, places in cell.sorted(same=True):
        n = min(k, scores.shape[1])
        anchor.append(np.repeat(own, n))
        place.append(places[:, :n].ravel())
        score.append(scores[:, :n].ravel())
    anchor, place, score = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (anchor, place, score))
    itself = np.array([inner_products(q[None], q[None])[0, 0] for q in cell.queries] or [0])
    ids = cell.ids.take(pa.array(place))
    same_id = pc.equal(ids, own_ids.take(pa.array(anchor))).fill_null(False).to_numpy(zero_copy_only=False)
    keys = anchors["anchor"].combine_chunks().take(pa.array(anchor))
    return pa.table([keys, pa.array(score), ids, pa.array(same_id & (score == itself[anchor]))], names=["anchor", "score", "id", "own"])


def _negatives(rows: pa.Table, anchors: pa.Table, scale: int, width: int, k: int, low: int, high: int) -> pa.Table:
    """For each positive of each anchor, the first k rows of other labels within its limits."""
    cell, wanted = _Cell(rows, anchors, scale, width), anchors["positives"].to_pylist()
    out: list[tuple] = []
    for own, scores, places in cell.sorted(same=False):
        for a, line, at in zip(own, scores, places, strict=True):
            falling = -line
            for p in wanted[a]:
                lower, upper = -(-low * p["score"] // 100), high * p["score"] // 100
                start, end = (int(np.searchsorted(falling, x, side)) for x, side in ((-upper, "left"), (-lower, "right")))
                out += [(a, p["nth"], p["id"], p["score"], int(line[i]), at[i]) for i in range(start, min(start + k, end))]
    a, nth, positive, positive_score, score, at = zip(*out, strict=True) if out else [[]] * 6
    take = lambda c: anchors[c].combine_chunks().take(pa.array(a, pa.int64()))
    cols = [take("anchor"), take("id"), pa.array(nth, pa.int32()), pa.array(positive, cell.ids.type), pa.array(positive_score, pa.int64()), pa.array(score, pa.int64()), cell.ids.take(pa.array(at, pa.int64()))]
    return pa.table(cols, names=["anchor", "anchor_id", "nth", "positive_id", "positive_score", "score", "id"])


def _grid(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int], cell: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Every anchor with every row, a block of each per task. Rows are dealt by their number, whatever they hold."""
    i, j = blocks
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda number, n: F.pmod(F.xxhash64(number), F.lit(n)).cast("int")
    left = rows.select("*", dealt(F.monotonically_increasing_id(), i).alias("i")).select("*", every(j).alias("j"))
    right = anchors.select("*", dealt("anchor", j).alias("j")).select("*", every(i).alias("i"))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(cell, schema)


def _first(hits: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k hits of each key, as nth; Spark limits groups before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return hits.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)


def mine(rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which anchors holds.

    A component x counts as floor(scale * x), a score is an inner product; higher scores come first,
    ties by smaller id, null ids last. An anchor's positives are its first ``positives`` other rows of
    its label. For each, the first ``negatives`` rows of another label follow whose score is at
    least low and at most high percent of the positive's (none if that is negative).

    Rows with a null label or vector, or a null or non-finite component, take no part. Shorter vectors
    end in zeros; a score beyond a long counts as the nearest long. Each of repeated rows is a row: as
    anchors each gives its results, as hits each counts. An empty table, no anchors, or no partners:
    no rows. Other columns are not read.
    """
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    number = rows.schema[vector].dataType.elementType.simpleString()
    sound = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, (lambda x: usable(x)) if number in ("float", "double") else (lambda x: x.isNotNull()))
    own = rows.filter(sound).select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    own = materialise(own, "vectors")  # so that a row's number stays
    asked = materialise(own.filter("is_anchor").select(F.monotonically_increasing_id().alias("anchor"), "id", "label", "vector"), "anchors")
    n, n_asked, width = own.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_anchor"), 1)), F.max(F.size("vector"))).first()
    own, width = own.drop("is_anchor"), max(1, width or 0)
    per = [max(1, min(most, BYTES // (8 * width))) for most in (ROWS, ANCHORS)]
    blocks = max(1, -(-n // per[0])), max(1, -(-n_asked // per[1]))
    kind = own.schema["id"].dataType.simpleString()

    found = _grid(own, asked, blocks, lambda r, a: _positives(r, a, scale, width, positives + 1), f"anchor long, score long, id {kind}, own boolean")
    top = _first(found, ["anchor"], positives + 1).withColumn("own_at", F.min(F.when(F.col("own"), F.col("at"))).over(Window.partitionBy("anchor")))
    top = top.filter(F.col("own_at").isNull() | (F.col("at") != F.col("own_at"))).withColumn("nth", (F.col("at") - F.coalesce((F.col("at") > F.col("own_at")).cast("int"), F.lit(0))).cast("int"))
    limits = top.filter(F.col("nth") <= positives).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "score", "id"))).alias("positives"))  # positives rows a group

    asked = asked.join(materialise(limits, "positives"), "anchor")
    schema = f"anchor long, anchor_id {kind}, nth int, positive_id {kind}, positive_score long, score long, id {kind}"
    found = _grid(own, asked, blocks, lambda r, a: _negatives(r, a, scale, width, negatives, low, high), schema)
    return _first(found, ["anchor", "nth"], negatives).select("anchor_id", "positive_id", F.col("at").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
