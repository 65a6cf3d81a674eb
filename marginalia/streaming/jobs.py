"""Continuous forms: ingest, task life cycle, audit counts, graph deltas, dedup, sessions.

Each function returns a streaming DataFrame or starts a query; checkpoints live in the folder
the caller names, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marginalia.operators.ingest import keep_first_copy
from marginalia.sources.batch_log import PARTS, BatchLog, Table
from marginalia.sources.readers import parse_content_lists, read_whole_files, split_corrupt
from marginalia.sources.writers import kb_log, upsert_kb, write_dead_letters

WATERMARK = "10 minutes"
SESSION_GAP = "30 minutes"
STAGE_TIMEOUT_MS = {"parsing": 600_000, "chunking": 300_000, "indexing": 300_000}


#: A log is compacted after so many batches, so that readers merge few.
COMPACT_EVERY = 64


def ingest_batch(folder: str, buckets: int = PARTS, dead_letters: str | None = None, stream: str = "",
                 compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` body that upserts newly arrived content lists into the chunk table.

    A batch appends what it adds and ends, and reads the partitions its documents and hashes fall in.
    ``stream`` names the stream that counts the batches, so that a replayed one is known.
    """
    def apply(files: DataFrame, batch_id: int) -> None:
        good, bad = split_corrupt(files)
        log = kb_log(files.sparkSession, folder, buckets)
        if dead_letters and not log.holds(stream, batch_id):
            write_dead_letters(bad, dead_letters)
        upsert_kb(log, parse_content_lists(good), stream, batch_id)
        if log.last - log.base >= compact_every:
            log.compact()

    return apply


def stream_ingest(spark: SparkSession, source: str, folder: str, checkpoint: str, buckets: int = PARTS,
                  available_now: bool = True, dead_letters: str | None = None) -> StreamingQuery:
    """Watch a folder for content lists and keep the chunk table current."""
    files = read_whole_files(spark, f"{source}/*_content_list.json", stream=True)
    writer = files.writeStream.foreachBatch(ingest_batch(folder, buckets, dead_letters, checkpoint)).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


SEEN = Table("seen", "content_md5 string", ("content_md5",), ("content_md5",))


def unseen(log: BatchLog, chunks: DataFrame) -> DataFrame:
    """The first copy of each hash that the log has not seen, read from the partitions of these hashes only."""
    first = keep_first_copy(chunks)
    return first.join(log.live("seen", log.parts_of(first, "content_md5")), "content_md5", "left_anti")


def dedup_stream(chunks: DataFrame, folder: str, checkpoint: str, available_now: bool = True, parts: int = PARTS,
                 compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Append only chunks whose hash was never stored, of equal ones in a batch the first by document and position.

    The hashes seen lie beside the checkpoint, by hash; a batch reads those partitions that its own
    hashes fall in and appends its new ones.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            log = BatchLog(batch.sparkSession, f"{checkpoint}-seen", [SEEN], parts)
            if log.holds("", batch_id):
                return
            # one folder per batch: replaying a batch overwrites its own output
            out = f"{folder}/batch_id={batch_id}"
            unseen(log, batch).write.mode("overwrite").parquet(out)
            log.write("seen", batch.sparkSession.read.schema(batch.schema).parquet(out))
            log.commit("", batch_id)
            if log.last - log.base >= compact_every:
                log.compact()
        finally:
            batch.unpersist()

    w = chunks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


TASK_OUTPUT = "task_uuid string, from_state string, to_state string, at timestamp, reason string"
TASK_COLUMNS = ["task_uuid", "from_state", "to_state", "at", "reason"]
TASK_STATE = "state string, since bigint, last bigint"

# ---- fixed values: what a life-cycle event does to a task ---------------------------------
NEXT_STATE = {
    ("received", "parse_start"): "parsing", ("parsing", "parse_done"): "chunking",
    ("chunking", "index_start"): "indexing", ("indexing", "graph_ok"): "done",
    ("indexing", "graph_failed"): "partial",
}
TERMINAL = ["done", "partial", "failed"]
# -------------------------------------------------------------------------------------------


def next_state(state: str, event: str) -> tuple[str, str | None]:
    """State after an event and the reason of a failure; events that do not apply change nothing."""
    if state in TERMINAL:
        return state, None
    if event == "cancel":
        return "failed", "cancelled"
    if event == "error":
        return "failed", "error"
    return NEXT_STATE.get((state, event), state), None


#: How long the end of a task is remembered, so that late events cannot start it anew.
RETENTION_MS = 7 * 86_400_000

#: Events of one task in one batch that are held in memory: about 1 MB; more go to the state store.
HELD_EVENTS = 10_000


class TaskLife(StatefulProcessor):
    """One task's life: its state in a value, the events of a large batch in a list, both in the state store.

    A batch's events come unordered. Up to ``HELD_EVENTS`` are sorted in memory and walked once, since every
    call to the state store is a round trip. More go to the list as they arrive, and each step looks
    there for the first event that changes the state, so memory holds few at a time.
    """

    def __init__(self, retention_ms: int):
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", TASK_STATE)
        self.waiting = handle.getListState("waiting", "at bigint, event string")

    def _first(self, state: str, since: int, after: tuple[int, str]) -> tuple[int, str] | None:
        """The earliest waiting event after the given one that ends the state, or comes past its limit."""
        limit, best = STAGE_TIMEOUT_MS.get(state), None
        for at, event in self.waiting.get():
            if after < (at, event) and (best is None or (at, event) < best):
                if next_state(state, event)[0] != state or limit and at // 1000 - since > limit:
                    best = (at, event)
        return best

    def _remember(self, state: str, since: int, last: int, watermark: int, known: bool = True) -> None:
        self.now.update((state, since, last))
        for due in list(self.handle.listTimers()) if known else []:  # a new task has none
            self.handle.deleteTimer(due)
        limit = STAGE_TIMEOUT_MS.get(state)
        self.handle.registerTimer(max(since + limit if limit else max(since, last) + self.retention_ms, watermark + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.now.get()
        state, since, last = known or ("received", 0, 0)
        held, stored = set(), False
        for chunk in rows:
            at = chunk["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            last = max(last, int(at.max()) // 1000)
            if state not in TERMINAL:
                held.update(zip(at.tolist(), chunk["event"].fillna("").tolist()))
            if len(held) > HELD_EVENTS:
                self.waiting.appendList(list(held))
                held, stored = set(), True
        if stored and held:
            self.waiting.appendList(list(held))
        in_order = iter(sorted(held))
        steps, place = [], (-1 << 63, "")
        while state not in TERMINAL:
            limit = STAGE_TIMEOUT_MS.get(state)
            found = self._first(state, since, place) if stored else next(
                (e for e in in_order if next_state(state, e[1])[0] != state or limit and e[0] // 1000 - since > limit), None)
            if not found:
                break
            place = found
            late = limit and place[0] // 1000 - since > limit
            new, reason = ("failed", "timeout") if late else next_state(state, place[1])
            steps.append((key[0], state, new, pd.Timestamp(place[0], unit="us"), reason))
            state, since = new, place[0] // 1000
        if stored:
            self.waiting.clear()
        self._remember(state, since, last, timerValues.getCurrentWatermarkInMs(), known is not None)
        if steps:
            yield pd.DataFrame(steps, columns=TASK_COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, since, last = self.now.get()
        limit = STAGE_TIMEOUT_MS.get(state)
        if not limit:  # ended, or never started, and remembered long enough
            self.now.clear()
            return
        at = since + limit
        self._remember("failed", at, last, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame([(key[0], state, "failed", pd.Timestamp(at, unit="ms"), "timeout")], columns=TASK_COLUMNS)

    def close(self) -> None:
        pass


def task_lifecycle(events: DataFrame, retention_ms: int = RETENTION_MS) -> DataFrame:
    """State changes of upload tasks; a stage that overruns its time limit fails, at the limit.

    ``events(task_uuid, event, ts)``; events of one time are taken by name, those without a time are
    left out. A task that went partial stays partial. The state of a task is one small row. A task
    that ended, by an event or by a timeout, is remembered for ``retention_ms`` of event time after
    its last event, then dropped; so is one that never started. What arrives within that time changes
    nothing any more. Needs the RocksDB state store (``session.RECOMMENDED``).
    """
    return (events.where(F.col("ts").isNotNull()).withWatermark("ts", WATERMARK).groupBy("task_uuid")
            .transformWithStateInPandas(TaskLife(retention_ms), TASK_OUTPUT, "Append", "EventTime"))


def audit_counts(log: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events per type and window; works on a batch or a stream of ``(ts, type)``."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    src = log.withWatermark("ts", WATERMARK) if log.isStreaming else log
    return src.groupBy(w.alias("w"), "type").agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "type", "events")


def graph_delta_stream(rows: DataFrame, key: list[str], folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append new nodes or edges, each once however the rows arrive.

    The keys seen are the state of the stream: a batch looks up and saves its own keys only, in the
    state store, and the sink's log shows readers whole batches.
    """
    w = rows.dropDuplicates(key).writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def session_activity(turns: DataFrame, gap: str = SESSION_GAP) -> DataFrame:
    """Turns per user session (30 minutes of silence end one); batch or stream of ``(ts, user_id)``."""
    src = turns.withWatermark("ts", WATERMARK) if turns.isStreaming else turns
    return src.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(
        F.count(F.lit(1)).alias("turns")).select(
        "user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "turns")
