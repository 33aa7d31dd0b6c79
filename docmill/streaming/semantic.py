"""The semantic cache over a stream of questions: keyed state that holds vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Least cosine of a hit, entries of a namespace, seconds that an entry lasts (fixed values).
LEAST, MOST, TTL = 0.97, 500, 1800.0


class SemanticCache(StatefulProcessor):
    """Answers a namespace's questions in order from its newest entries; a miss with an answer becomes an entry.

    State is a map from an entry's number to the entry. A batch reads it once, and writes only what is new
    or gone; it never holds more than ``most`` entries.
    """

    def __init__(self, least: float, most: int, ttl: float):
        self.least, self.most, self.ttl = least, most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "number long", "asked_id string, answer string, vector array<double>, expires double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = sorted((n[0], e) for n, e in self.entries.iterator())
        numbers = [n for n, _ in held]
        about = [(e[0], e[1], e[3]) for _, e in held]
        vectors = [np.array(e[2]) for _, e in held]
        following = numbers[-1] + 1 if numbers else 0
        for r in sorted(rows, key=lambda r: (r["asked_at"], str(r["asked_id"]))):
            now = r["asked_at"].timestamp()
            late = [i for i, (_, _, expires) in enumerate(about) if expires <= now]
            if late:
                for i in reversed(late):
                    self.entries.removeKey((numbers.pop(i),))
                    del about[i], vectors[i]
            own = _unit(r["embedding"])
            scores = _cosines(vectors, own) if own is not None and vectors else np.zeros(0)
            best = int(np.argmax(scores)) if len(scores) and scores.max() >= self.least else None  # the oldest of equals
            if best is not None:
                yield Row(namespace=key[0], asked_id=r["asked_id"], hit=True, cached_id=about[best][0], answer=about[best][1], score=float(scores[best]))
                continue
            yield Row(namespace=key[0], asked_id=r["asked_id"], hit=False, cached_id=None, answer=r["answer"], score=None)
            if own is not None and r["answer"] is not None and self.most > 0:
                self.entries.updateValue((following,), (str(r["asked_id"]), r["answer"], own.tolist(), now + self.ttl))
                numbers.append(following)
                about.append((str(r["asked_id"]), r["answer"], now + self.ttl))
                vectors.append(own)
                following += 1
                if len(numbers) > self.most:
                    self.entries.removeKey((numbers.pop(0),))
                    del about[0], vectors[0]

    def close(self) -> None:
        pass


def _unit(vector: list | None) -> np.ndarray | None:
    """The vector at length one; None if it is null, unsound or zero."""
    if vector is None or any(x is None for x in vector):
        return None
    own = np.array(vector, float)
    norm = np.linalg.norm(own)
    return own / norm if 0 < norm < np.inf else None


def _cosines(vectors: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors; one of another length is as far as can be."""
    same = np.array([len(v) == len(own) for v in vectors])
    out = np.full(len(vectors), -1.0)
    if same.any():
        out[same] = (np.stack([v for v, s in zip(vectors, same, strict=True) if s]) @ own).round(6)
    return out


def semantic_answers(asked: DataFrame, least: float = LEAST, most: int = MOST, ttl: float = TTL) -> DataFrame:
    """(namespace, asked_id, hit, cached_id, answer, score) of a stream of (namespace, asked_id, embedding, answer, asked_at).

    A question takes the answer of the nearest entry of its namespace, if their cosine is least or
    more and the entry isn't older than ttl seconds; else its own answer, null if none was made, which
    becomes an entry. Of more than most entries the oldest go. A batch's questions are taken by time,
    ties by id, for which a task holds those of a namespace; the source's limit on a batch bounds
    them. Questions without a sound vector never hit and leave no entry. Whether a question
    leaves one depends on those before it, so a namespace is one key: its task compares them in turn with
    at most ``most`` vectors.
    """
    schema = "namespace string, asked_id string, hit boolean, cached_id string, answer string, score double"
    own = asked.selectExpr("cast(namespace as string) namespace", "cast(asked_id as string) asked_id", "embedding", "answer", "asked_at")
    return own.groupBy("namespace").transformWithState(SemanticCache(least, most, ttl), schema, "Append", "None")
