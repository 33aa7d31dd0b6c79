"""Streams of answers: pieces of bytes become events, with the unfinished line as keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a line of an event begins with (fixed value).
MARK = b"data: "
EVENTS = "session string, n long, type string, content string, payload string"


def event_of(line: bytes) -> tuple[str, str | None, str] | None:
    """(type, content, payload) of a line; None if it is no event or no JSON object. content: a text's words, an error's message."""
    line = line.rstrip(b"\r")
    if not line.startswith(MARK):
        return None
    payload = line[len(MARK) :].decode("utf-8", "replace")
    try:
        found = json.loads(payload)
    except ValueError:
        return None
    if not isinstance(found, dict) or not isinstance(found.get("type"), str):
        return None
    content = found.get("message", found.get("content")) if found["type"] == "error" else found.get("content")
    return found["type"], content if isinstance(content, str) else None, payload


class Lines(StatefulProcessor):
    """A session's bytes since its last line feed, and the number of its next event; a closed session leaves nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "bytes binary, n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        rest, n = self.rest.get() if self.rest.exists() else (b"", 0)
        rest, closed = bytes(rest), False
        for r in sorted(rows, key=lambda r: r["seq"]):
            *lines, rest = (rest + bytes(r["piece"] or b"")).split(b"\n")
            if r["done"]:
                lines, rest, closed = [*lines, rest], b"", True
            for found in filter(None, map(event_of, lines)):
                yield Row(session=key[0], n=n, type=found[0], content=found[1], payload=found[2])
                n += 1
        if closed:
            self.rest.clear()
        else:
            self.rest.update((rest, n))

    def close(self) -> None:
        pass


def answer_events(pieces: DataFrame) -> DataFrame:
    """(session, n, type, content, payload) of a stream of (session, seq, piece, done): typed events, numbered by session.

    A line that a piece leaves unfinished, within a character even, waits for the next; done ends it.
    Lines that aren't events and broken JSON give nothing. Pieces of a session come in the order of
    seq, batch after batch; a batch's are put in order. A null piece is empty, null sessions go.
    State is a line a session, and none once it is done.
    """
    own = pieces.filter("session is not null").select(F.col("session").cast("string").alias("session"), "seq", "piece", F.coalesce("done", F.lit(False)).alias("done"))
    return own.groupBy("session").transformWithState(Lines(), EVENTS, "Append", "None")


def answers(events: DataFrame) -> DataFrame:
    """(session, answer, error) of ``answer_events``: texts up to the first error in order, and that error."""
    first = F.min(F.when(F.col("type") == "error", F.struct("n", "content")))
    own = events.groupBy("session").agg(first.alias("first"), F.sort_array(F.collect_list(F.when(F.col("type") == "text", F.struct("n", "content")))).alias("texts"))  # a session's events
    before = F.filter("texts", lambda t: F.col("first").isNull() | (t["n"] < F.col("first.n")))
    return own.select("session", F.array_join(F.transform(before, lambda t: F.coalesce(t["content"], F.lit(""))), "").alias("answer"), F.col("first.content").alias("error"))
