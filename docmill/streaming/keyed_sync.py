"""Synchronisation as keyed state: documents' states change with their own records and timers.

The key is one of BUCKETS hashes of source_id, for a call of the state store costs more than a document's
work: a bucket's documents are read and written in one call each. A batch costs the buckets that it brings
records or misses to; all others are not touched. Runs of a crawl are told apart by their event time. A
document that is seen falls due just after the run; the bucket's timer stands at the first of them. When the
watermark has passed the next run and the document wasn't seen there, the timer fires: a miss.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

VISIBLE = ("active", "updated")
#: Keys of the state: some thousand documents a bucket where there are millions. Part of a checkpoint: another number needs a new one.
BUCKETS = 1 << 12
FIELDS = ("source_id", "content_hash", "status", "miss_count", "is_pinned")
STATE = "source_id array<string>, content_hash array<string>, status array<string>, miss_count array<int>, is_pinned array<boolean>, due array<long>, timer long"
CHANGES = "source_id string, run_at timestamp, change string, status string, miss_count int, content_hash string, should_index boolean"


class DocumentSync(StatefulProcessor):
    """A bucket: status, hash, misses, whether it is pinned, and when it falls due (0: never) of each document, and the time of the timer (0: none)."""

    def __init__(self, detect_missing: bool):
        self.detect_missing = detect_missing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", STATE)

    def _read(self) -> tuple[dict, int]:
        """(documents by source_id, time of the timer)."""
        if (found := self.bucket.get()) is None:
            return {}, 0
        *columns, timer = found
        return {x: rest for x, *rest in zip(*columns, strict=True)}, timer

    def _write(self, documents: dict, timer: int, fired: bool = False) -> None:
        """Store the documents; the timer stands at the first time that one falls due."""
        first = min((d[-1] for d in documents.values() if d[-1]), default=0)
        if first != timer or fired:
            if timer and not fired:
                self.handle.deleteTimer(timer)
            if first:
                self.handle.registerTimer(first)
        columns = zip(*((x, *rest) for x, rest in documents.items()), strict=True)
        self.bucket.update((*map(list, columns), first))

    def _due(self, status: str, after: int) -> int:
        """While a document is visible, it falls due just after the given time."""
        return after + 1 if self.detect_missing and status in VISIBLE else 0

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:  # noqa: N802, N803
        documents, timer = self._read()
        for d in initialState["documents"]:
            documents[d["source_id"]] = [d["content_hash"], d["status"], d["miss_count"], d["is_pinned"], self._due(d["status"], 0)]
        self._write(documents, timer)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = {}  # of each document and run; a batch holds few runs
        for r in rows:
            own = r["source_id"], r["run_at"]
            old = last.get(own)
            if old is None or (r["seen_at"], r["content_hash"] or "") >= (old["seen_at"], old["content_hash"] or ""):
                last[own] = r
        documents, timer = self._read()
        for (source_id, run_at), r in sorted(last.items()):
            old_hash, status, *_ = documents.get(source_id, (None, None))
            if r["failed"]:
                change = status = "parse_failed"
            elif status is None:
                change, status = "new", "active"
            elif old_hash is None or r["content_hash"] is None or old_hash != r["content_hash"] or status in ("hidden", "deleted", "parse_failed"):
                change = status = "updated"
            else:
                change, status = "unchanged", "active"
            documents[source_id] = [r["content_hash"], status, 0, bool(r["is_pinned"]), self._due(status, round(run_at.timestamp() * 1000))]
            yield Row(source_id=source_id, run_at=run_at, change=change, status=status, miss_count=0, content_hash=r["content_hash"], should_index=change in ("new", "updated"))
        self._write(documents, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        documents, timer = self._read()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        run = timerValues.getCurrentWatermarkInMs()
        for source_id, (content_hash, status, misses, pinned, due) in documents.items():
            if not 0 < due <= run:
                continue
            misses += 1
            change = "missed" if pinned and misses < 2 else "hidden"
            status = status if change == "missed" else "hidden"
            documents[source_id] = [content_hash, status, misses, pinned, self._due(status, run)]
            yield Row(source_id=source_id, run_at=_moment(run), change=change, status=status, miss_count=misses, content_hash=content_hash, should_index=False)
        self._write(documents, timer, fired=True)

    def close(self) -> None:
        pass


def _moment(ms: int):  # noqa: ANN202
    from datetime import datetime, timezone

    return datetime.fromtimestamp(ms / 1000, timezone.utc)


def sync_changes(records: DataFrame, detect_missing: bool = False, snapshot: DataFrame | None = None) -> DataFrame:
    """Changes of a stream of records (source_id, content_hash, failed, is_pinned, run_at, seen_at): what ``sync.diff`` finds in each run, without the untouched.

    run_at is the time of the run, the same for its records; run by run it rises. Of a document's records in
    a run the last seen counts, ties by the larger hash. Misses of a run come when the watermark, which
    follows run_at, has passed it: with the batch after it, which Spark runs by itself. Of runs that come in
    one batch only the last counts for misses. snapshot:
    the documents (source_id, content_hash, status, miss_count, is_pinned) before the first run.
    Records without a source_id are left out. Output is an append-only table of changes.
    """
    bucket = F.pmod(F.xxhash64("source_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    own = records.filter("source_id is not null and source_id != ''").withWatermark("run_at", "0 seconds").withColumn("bucket", bucket)
    first = None
    if snapshot is not None:
        known = snapshot.select("source_id", "content_hash", "status", F.coalesce("miss_count", F.lit(0)).cast("int").alias("miss_count"), F.coalesce("is_pinned", F.lit(False)).alias("is_pinned"))
        first = known.groupBy(bucket).agg(F.collect_list(F.struct(*FIELDS)).alias("documents")).groupBy("bucket")  # a bucket's documents
    return own.groupBy("bucket").transformWithState(DocumentSync(detect_missing), CHANGES, "Append", "EventTime", initialState=first)


def latest_documents(changes: DataFrame) -> DataFrame:
    """(source_id, content_hash, status, miss_count) of each document after all changes: the snapshot, when one is asked for."""
    order = F.struct("run_at", F.col("change").isin("missed", "hidden"))
    return changes.groupBy("source_id").agg(*(F.max_by(c, order).alias(c) for c in ("content_hash", "status", "miss_count")))
