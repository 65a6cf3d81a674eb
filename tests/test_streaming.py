"""Streams run to the end of their input equal batches and hand-made state walks."""

import json
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia.operators import ingest
from marginalia.sources import readers as R
from marginalia.streaming import jobs as J


def write(path, name, texts, kind="text"):
    (path / f"{name}_content_list.json").write_text(json.dumps(
        [{"type": kind, "text": t, "page_idx": i} for i, t in enumerate(texts)]), encoding="utf-8")


def long(t):
    return f"{t} is a paragraph of sufficient length for the gate."


def test_ingest_keeps_the_table_current(spark, tmp_path):
    src, kb, state = tmp_path / "in", str(tmp_path / "kb"), str(tmp_path / "state")
    src.mkdir()
    run = lambda: J.stream_ingest(spark, str(src), kb, state, buckets=4, dead_letters=str(tmp_path / "dead")).awaitTermination()
    rows = lambda: sorted((r.doc_name, r.text) for r in R.load_kb(spark, kb).collect())
    write(src, "a", [long("one"), long("two"), "short"])
    write(src, "b", [long("two"), long("three")])
    (src / "c_content_list.json").write_text("[broken")
    run()
    first = rows()
    assert first == [("a", long("one")), ("a", long("two")), ("b", long("three"))]
    assert spark.read.json(str(tmp_path / "dead")).count() == 1
    run()  # nothing new
    assert rows() == first
    # a later file of the same name is a new version: under a new path, as file sources see it
    newer = tmp_path / "in2"
    newer.mkdir()
    write(newer, "a", [long("one"), long("four"), long("three")])
    J.stream_ingest(spark, str(newer), kb, str(tmp_path / "state2"), buckets=4).awaitTermination()
    assert rows() == [("a", long("four")), ("a", long("one")), ("b", long("three"))]
    # a document whose chunks all went leaves no rows behind
    gone = tmp_path / "in3"
    gone.mkdir()
    write(gone, "b", ["short"])
    J.stream_ingest(spark, str(gone), kb, str(tmp_path / "state3"), buckets=4).awaitTermination()
    assert rows() == [("a", long("four")), ("a", long("one"))]


def test_reingest_adds_and_removes_nothing(spark, tmp_path):
    from marginalia.operators.incremental import upsert_documents
    write(tmp_path, "a", [long("one"), long("two"), long("one")])
    items = R.read_content_lists(spark, str(tmp_path))
    stored = ingest.build_chunks(items).checkpoint() if spark.sparkContext.getCheckpointDir() else ingest.build_chunks(items)
    state, counts = upsert_documents(stored, items)
    assert state.count() == stored.count() == 2
    assert [tuple(r) for r in counts.select("kept", "stale", "added").collect()] == [(2, 0, 0)]


def test_dedup_stream_over_batches(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    schema = "doc_name string, chunk_idx bigint, content_md5 string"
    for i, hashes in enumerate([["a", "b", "a"], ["b", "c"]]):
        spark.createDataFrame([(f"d{i}", j, h) for j, h in enumerate(hashes)], schema).coalesce(1).write.mode("append").json(str(src))
        J.dedup_stream(spark.readStream.schema(schema).json(str(src)), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.content_md5, r.doc_name) for r in spark.read.parquet(out).collect()) == [("a", "d0"), ("b", "d0"), ("c", "d1")]


def walk(events):
    """The life cycle of one task, step by step."""
    state, since, out = "received", None, []
    for event, ts in events:
        limit = J.STAGE_TIMEOUT_MS.get(state)
        if limit and since is not None and (ts - since).total_seconds() * 1000 > limit:
            new, reason = "failed", "timeout"
        else:
            new, reason = J.next_state(state, event)
        if new != state:
            out.append((state, new, reason))
            state, since = new, ts
    return out


def lifecycle(spark, path, batches):
    """Run the stream over one file per batch; (from, to, reason) per task in order."""
    schema = "task_uuid string, event string, ts timestamp"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(path / "ev"))
        src = spark.readStream.schema(schema).json(str(path / "ev"))
        q = (J.task_lifecycle(src).writeStream.format("parquet").option("path", str(path / "out"))
             .option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start())
        q.awaitTermination()
    got = {}
    for r in spark.read.parquet(str(path / "out")).orderBy("task_uuid", "at").collect():
        got.setdefault(r.task_uuid, []).append((r.from_state, r.to_state, r.reason))
    return got


@pytest.mark.parametrize("cuts", [1, 3])
def test_lifecycle_equals_a_walk(spark, tmp_path, cuts):
    rnd, start = random.Random(5), datetime(2024, 1, 1)
    kinds = ["parse_start", "parse_done", "index_start", "graph_ok", "graph_failed", "cancel", "error"]
    rows, want = [], {}
    for task in range(40):
        at, events = start + timedelta(minutes=task), []
        for step in range(6):
            at += timedelta(seconds=rnd.choice([5, 50, 250, 700]))
            kind = kinds[min(step, 3)] if rnd.random() < 0.75 else rnd.choice(kinds)
            events.append((kind, at))
            rows.append((f"t{task}", kind, at))
        want[f"t{task}"] = walk(events)
    rows.sort(key=lambda r: r[2])
    size = -(-len(rows) // cuts)
    got = lifecycle(spark, tmp_path, [rows[i:i + size] for i in range(0, len(rows), size)])
    for task, steps in want.items():
        extra = got.get(task, [])[len(steps):]
        assert got.get(task, [])[:len(steps)] == steps
        assert all(s[1:] == ("failed", "timeout") for s in extra)  # silent stages run out of time


class Store:
    """A state store's value, list and timers; counts the round trips."""

    def __init__(self):
        self.value, self.rows, self.timers, self.calls = None, [], [], []

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("get", "listTimers"):
                return iter(self.timers) if name == "listTimers" else self.value
            if name == "update":
                self.value = args[0]
            elif name == "registerTimer":
                self.timers.append(args[0])
            elif name == "deleteTimer":
                self.timers.remove(args[0])
        return call


class Waiting(Store):
    def appendList(self, rows):
        self.calls.append("appendList")
        self.rows += rows

    def get(self):
        self.calls.append("get")
        return iter(self.rows)

    def clear(self):
        self.calls.append("clear")
        self.rows = []


def test_few_events_of_a_task_are_not_put_into_the_store(monkeypatch):
    import pandas as pd
    from types import SimpleNamespace
    rnd, start, got = random.Random(7), pd.Timestamp("2024-01-01"), []
    kinds = ["parse_start", "parse_done", "index_start", "graph_ok", "graph_failed", None]
    tasks = [[(start + pd.Timedelta(seconds=rnd.choice([0, 60, 200, 700]) + 90 * i), rnd.choice(kinds[:i % 6 + 1])) for i in range(12)] for _ in range(60)]
    for most in (10_000, 3):
        monkeypatch.setattr(J, "HELD_EVENTS", most)
        rows, used = [], 0
        for n, events in enumerate(tasks):
            life, now, waiting = J.TaskLife(1000), Store(), Waiting()
            life.handle, life.now, life.waiting = now, now, waiting
            for part in (events[:8], events[8:]):
                chunks = [pd.DataFrame(part[i:i + 2], columns=["ts", "event"]) for i in range(0, len(part), 2)]
                for out in life.handleInputRows((f"t{n}",), iter(chunks), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)):
                    rows += out.itertuples(index=False, name=None)
            assert len(now.timers) == 1
            used += len(waiting.calls)
        got.append(rows)
        assert (used == 0) == (most == 10_000)
    assert got[0] == got[1] and len(got[0]) > 60


def test_a_task_that_timed_out_stays_so(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    got = lifecycle(spark, tmp_path, [[("a", "parse_start", at(0))], [("b", "parse_start", at(60))], [("c", "parse_start", at(61))],
                                      [("a", "parse_done", at(62)), ("a", "parse_start", at(63))], [("d", "cancel", at(90))]])
    assert got["a"] == [("received", "parsing", None), ("parsing", "failed", "timeout")]


def test_graph_delta_is_once_per_key_over_any_batches(spark, tmp_path):
    schema = "source string, target string, seen_at timestamp"
    for day in range(1, 5):
        spark.createDataFrame([("a", "b", datetime(2024, 1, day)), ("a", f"x{day}", datetime(2024, 1, day))] * 2, schema).coalesce(1) \
            .write.mode("append").json(str(tmp_path / "src"))
        J.graph_delta_stream(spark.readStream.schema(schema).json(str(tmp_path / "src")), ["source", "target"],
                             str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.source, r.target) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "b"), ("a", "x1"), ("a", "x2"), ("a", "x3"), ("a", "x4")]


def test_lifecycle_transitions():
    assert J.next_state("indexing", "graph_failed") == ("partial", None)
    assert J.next_state("partial", "error") == ("partial", None)
    assert J.next_state("parsing", "cancel") == ("failed", "cancelled")
    assert J.next_state("received", "graph_ok") == ("received", None)


def test_audit_stream_reads_the_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    lines = [json.dumps({"ts": f"2024-01-01T0{h}:15:00+00:00", "type": t}) for h in range(4) for t in ("api", "login", "api")]
    (tmp_path / "log" / "a.log").write_text("\n".join([*lines, "garbage"]))
    log = R.read_audit(spark, str(tmp_path / "log"), stream=True)
    q = (J.audit_counts(log).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = J.audit_counts(R.read_audit(spark, str(tmp_path / "log"))).where(F.col("window_end") <= "2024-01-01 03:05:00")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(*got.columns).collect())) and got.count() == 6
