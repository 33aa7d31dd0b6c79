"""Keyed state of streams: synchronisation and the semantic cache, against their batch forms."""

import random
import time
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import sync
from docmill.plans.shared import scratch, table
from docmill.queries import streams
from docmill.streaming import answers, jobs, keyed_sync, semantic
from docmill.streaming.drain import drained

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def stateful(spark):
    old = {k: spark.conf.get(k) for k in (PROVIDER, "spark.sql.shuffle.partitions")}
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


RECORD = "source_id string, content_hash string, failed boolean, is_pinned boolean, run_at timestamp, seen_at long"
DOCUMENT = "source_id string, content_hash string, status string, miss_count int, is_pinned boolean"
START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def runs(seed, n_runs=4, n=40):
    random.seed(seed)
    out = []
    for k in range(n_runs):
        rows = []
        for i in range(n):
            if random.random() < 0.7:
                rows += [(f"d{i}", f"h{random.choice([0, 0, 0, k])}", random.random() < 0.1, i % 3 == 0, START + timedelta(hours=k), s) for s in range(random.choice([1, 1, 2]))]
        out.append([*rows, ("", "h", False, False, START + timedelta(hours=k), 0), (None, "h", False, False, START + timedelta(hours=k), 0)])
    return out


@pytest.mark.parametrize("start_from_snapshot", [False, True])
def test_changes_equal_the_batch_diff_of_each_run(stateful, tmp_path, start_from_snapshot):
    spark = stateful
    known = [(f"d{i}", "h0", ["active", "hidden", "updated", "parse_failed"][i % 4], i % 2, i % 3 == 0) for i in range(30)] + [("gone", "h", "active", 0, False)]
    snapshot = spark.createDataFrame(known if start_from_snapshot else [], DOCUMENT)
    want = {}
    state = snapshot
    batches = runs(7)
    for k, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, RECORD)
        last = batch.groupBy("source_id").agg(*(F.max_by(c, F.struct("seen_at", "content_hash")).alias(c) for c in ("content_hash", "failed", "is_pinned")))
        changes = sync.diff(state, last, True).collect()
        want[k] = sorted((r["source_id"], r["change"], r["status"], r["miss_count"], r["content_hash"], r["should_index"]) for r in changes if r["change"] != "untouched")
        pins = {r["source_id"]: r["is_pinned"] for r in state.collect()} | {r["source_id"]: r["is_pinned"] for r in last.collect()}
        state = spark.createDataFrame([(r["source_id"], r["content_hash"], r["status"], r["miss_count"], pins[r["source_id"]]) for r in changes], DOCUMENT)
    out = str(tmp_path / "out")
    for k in range(len(batches) + 1):  # a new query for each run: all state comes from the checkpoint
        rows = batches[k] if k < len(batches) else [("later", "h", False, False, START + timedelta(hours=k), 0)]
        spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(RECORD).parquet(str(tmp_path / "in"))
        query = keyed_sync.sync_changes(stream, True, snapshot if start_from_snapshot else None).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(200)
    got = {}
    for r in spark.read.parquet(out).withColumn("k", ((F.col("run_at").cast("long") - int(START.timestamp())) / 3600).cast("int")).collect():
        got.setdefault(r["k"], []).append((r["source_id"], r["change"], r["status"], r["miss_count"], r["content_hash"], r["should_index"]))
    for k in want:
        assert sorted(got[k]) == want[k]
    assert {c for rows in want.values() for _, c, *_ in rows} == {"new", "updated", "unchanged", "parse_failed", "missed", "hidden"}
    left = {r["source_id"]: (r["status"], r["miss_count"]) for r in state.collect()}
    latest = {r["source_id"]: (r["status"], r["miss_count"]) for r in keyed_sync.latest_documents(spark.read.parquet(out).filter(F.col("run_at") < F.lit(START + timedelta(hours=len(batches))))).collect()}
    assert all(left[s] == v for s, v in latest.items()) and len(latest) >= 30


QUESTION = "namespace string, asked_id long, embedding array<double>, answer string, asked_at timestamp"


def replay(questions, least, most, ttl):
    """The cache question by question."""
    held, out = {}, {}
    unit = lambda v: None if v is None or None in v or not 0 < np.linalg.norm(v) < np.inf else np.array(v) / np.linalg.norm(v)
    for space, i, v, answer, at in questions:
        own, entries = unit(v), held.setdefault(space, [])
        entries[:] = [e for e in entries if e[3] > at.timestamp()]
        best = max(((round(float(e[0] @ own), 6), -n) for n, e in enumerate(entries) if own is not None and len(e[0]) == len(own)), default=(-2, 0))
        if best[0] >= least:
            out[i] = (True, str(entries[-best[1]][1]), entries[-best[1]][2], best[0])
            continue
        out[i] = (False, None, answer, None)
        if own is not None and answer is not None:
            entries.append((own, i, answer, at.timestamp() + ttl))
            del entries[:-most]
    return out


def asked_questions(n=160):
    random.seed(11)
    out = []
    for i in range(n):
        v = [random.choice([0.0, 1.0, 2.0]) + random.random() * 0.1 for _ in range(3)]
        v = None if i % 41 == 5 else [*v[:2], None] if i % 41 == 6 else v[:2] if i % 41 == 7 else [0.0, 0.0, 0.0] if i % 41 == 8 else v
        out.append(("hot" if i % 3 else f"s{i % 6}", i, v, None if i % 13 == 2 else f"a{i}", START + timedelta(seconds=i * 5)))
    return out


def test_cache_equals_a_replay_in_order(stateful, tmp_path):
    spark, questions, got = stateful, asked_questions(), {}
    want = replay(questions, 0.97, 8, 200.0)
    for a in range(0, len(questions), 40):
        spark.createDataFrame(random.sample(questions[a : a + 40], 40), QUESTION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = semantic.semantic_answers(spark.readStream.schema(QUESTION).parquet(str(tmp_path / "in")), most=8, ttl=200.0)
        take = lambda df, n: got.update({int(r["asked_id"]): (r["hit"], r["cached_id"], r["answer"], r["score"]) for r in df.collect()})
        stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(200)
    assert got == want and 20 < sum(h for h, *_ in got.values()) < 150


def test_cache_finds_what_the_batch_form_finds(stateful, tmp_path):
    """Distant entries are stored first, then questions without answers look them up."""
    spark = stateful
    random.seed(2)
    own = [np.eye(6)[i % 6] * (1 if i < 6 else -1) for i in range(12)]
    first = [("n", i, v.tolist(), f"a{i}", START + timedelta(seconds=i)) for i, v in enumerate(own)]
    now = START + timedelta(seconds=100)
    later = [("n", 100 + i, (own[i % 12] + np.random.default_rng(i).normal(size=6) * 0.15).tolist(), None, now) for i in range(60)]
    later = [(s, i, (np.array(v) / np.linalg.norm(v)).tolist(), a, t) for s, i, v, a, t in later]
    out = []
    for rows in (first, later):
        spark.createDataFrame(rows, QUESTION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = semantic.semantic_answers(spark.readStream.schema(QUESTION).parquet(str(tmp_path / "in")))
        stream.writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(200)
    cached = spark.createDataFrame(first, QUESTION).select("namespace", F.col("asked_id").alias("cached_id"), "embedding", F.col("asked_at").alias("created"))
    want = jobs.recent_answers(spark.createDataFrame(later, QUESTION).select("namespace", "asked_id", "embedding"), cached, now).collect()
    assert sorted((int(r["asked_id"]), int(r["cached_id"]), r["score"]) for r in out if r["hit"]) == sorted((r["asked_id"], r["cached_id"], r["score"]) for r in want)
    assert 0 < len(want) < 60


def test_a_full_namespace_is_fast():
    cache = semantic.SemanticCache(0.97, 500, 1800.0)

    class Held:
        def __init__(self):
            self.rows = {}

        def iterator(self):
            return iter(self.rows.items())

        def updateValue(self, k, v):  # noqa: N802
            self.rows[k] = v

        def removeKey(self, k):  # noqa: N802
            del self.rows[k]

    cache.entries = Held()
    rng = np.random.default_rng(1)
    rows = [{"asked_id": i, "embedding": rng.normal(size=64).tolist(), "answer": "a", "asked_at": START + timedelta(milliseconds=i)} for i in range(2000)]
    began = time.perf_counter()
    out = list(cache.handleInputRows(("n",), iter(rows), None))
    assert len(out) == 2000 and len(cache.entries.rows) == 500 and time.perf_counter() - began < 10


def test_cache_query_equals_a_replay(spark, sf):
    rows = table(spark, sf, "embeddings").collect()
    questions = sorted(((str(r["label"]), r["vec_id"], [float(x) for x in r["embedding"]], f"a{r['vec_id']}" if r["vec_id"] % 9 else None, START + timedelta(seconds=r["vec_id"])) for r in rows), key=lambda q: q[1])
    got = {int(r["asked_id"]): (r["hit"], r["cached_id"], r["answer"], r["score"]) for r in streams.cache_stream(spark, sf).collect()}
    want = replay(questions, 0.35, 50, 300.0)
    assert {i: v[:3] for i, v in got.items()} == {i: v[:3] for i, v in want.items()} and 10 < sum(v[0] for v in got.values()) < len(got)


BODY = 'data: {"type": "metadata", "n": 1}\n\ndata: {"type": "text", "content": "안녕 "}\r\nevent: x\ndata: broken\ndata: [1]\ndata: {"type": "text", "content": "a\\nb 🙂"}\ndata: {"type": "error", "message": "late"}\ndata: {"type": "text", "content": "gone"}'.encode()
WANT = [("metadata", None), ("text", "안녕 "), ("text", "a\nb 🙂"), ("error", "late"), ("text", "gone")]


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_pieces_cut_at_every_byte_give_the_same_events():
    for at in range(len(BODY) + 1):
        for step in (len(BODY), 1, 7):
            lines = answers.Lines()
            lines.rest, out = Value(), []
            pieces = [BODY[:at], *(BODY[i : i + step] for i in range(at, len(BODY), step))]
            for seq, piece in enumerate(pieces):
                out += lines.handleInputRows(("s",), iter([{"seq": seq, "piece": piece, "done": seq == len(pieces) - 1}]), None)
            assert [(e["type"], e["content"]) for e in out] == WANT and [e["n"] for e in out] == list(range(5)) and lines.rest.value is None


def test_answer_events_over_batches(stateful, tmp_path):
    spark, kind = stateful, "session string, seq long, piece binary, done boolean"
    rows = [(s, i, BODY[a : a + 11], a + 11 >= len(BODY) and s != "open") for s in ("x", "y", "open") for i, a in enumerate(range(0, len(BODY), 11))] + [(None, 0, b"data: {}", True), ("null", 0, None, None)]
    for k in range(3):  # each query starts from the checkpoint
        spark.createDataFrame([r for r in rows if r[1] % 50 // 9 == k or k == 2 and r[1] >= 27], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = answers.answer_events(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(200)
    found = spark.read.parquet(str(tmp_path / "out"))
    got = {s: [(r["type"], r["content"]) for r in found.filter(F.col("session") == s).orderBy("n").collect()] for s in ("x", "y", "open", "null")}
    assert got == {"x": WANT, "y": WANT, "open": WANT[:4], "null": []}
    assert {(r["session"], r["answer"], r["error"]) for r in answers.answers(found).collect()} == {(s, "안녕 a\nb 🙂", "late") for s in ("x", "y", "open")}


def test_a_bucket_of_documents_takes_one_read_and_one_write():
    calls = []

    class Store:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return Store()

        def registerTimer(self, at):  # noqa: N802
            calls.append(f"register {at}")

        def deleteTimer(self, at):  # noqa: N802
            calls.append(f"delete {at}")

    own = keyed_sync.DocumentSync(True)
    own.init(Handle())
    own.handleInitialState((3,), {"documents": [{"source_id": f"d{i}", "content_hash": "h", "status": "active", "miss_count": 0, "is_pinned": False} for i in range(100)]}, None)
    assert calls == ["get", "register 1", "update"]
    calls.clear()
    rows = [{"source_id": f"d{i}", "content_hash": "h", "failed": False, "is_pinned": False, "run_at": START, "seen_at": 0} for i in range(100)]
    assert {r.change for r in own.handleInputRows((3,), iter(rows), None)} == {"unchanged"}
    assert calls == ["get", "delete 1", f"register {int(START.timestamp()) * 1000 + 1}", "update"]


def test_batches_of_answers_are_written_by_many_tasks(spark, sf, monkeypatch):
    made = []
    monkeypatch.setattr(streams, "scratch", lambda *a: made.append(name := scratch(*a)) or name)
    monkeypatch.setattr(streams, "drained", lambda *a: made.append(out := drained(*a)) or out)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r["session"]: (r["n_chars"], r["answer_md5"]) for r in streams.answer_stream(spark, sf).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    pieces = spark.read.parquet(next(m for m in made if isinstance(m, str) and "/pieces-" in m))
    rows = [n for (n,) in pieces.groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(rows) > 3 and max(rows) < sum(rows) / 3
    texts = table(spark, sf, "conversations").filter("role <> 'system'").groupBy(F.col("conv_id").cast("string").alias("s")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t")).collect()
    want = {r["s"]: "".join(t["text"] or "" for t in r["t"]) for r in texts}
    assert all(got[s][0] == len(w) for s, w in want.items()) and len(got) >= len(want) > 0
