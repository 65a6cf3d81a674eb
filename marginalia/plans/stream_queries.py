"""Queries whose rows come out of streaming jobs run to the end of the available data."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import model_map as MM
from marginalia.plans import inputs as I
from marginalia.plans.chunk_queries import NUMBER, STATE, new_items, upserted, versions
from marginalia.plans.registry import query
from marginalia.session import ensure_checkpoint_dir, forget, free_shuffles
from marginalia.sources.readers import load_kb
from marginalia.streaming import jobs as J


def _scratch(spark: SparkSession) -> str:
    """A fresh folder next to the checkpoints, in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(str(Path(path).parent) + f"/{name}*.parquet")


def _drain(spark: SparkSession, out: DataFrame) -> DataFrame:
    """Run a stream over everything available into parquet, and read it back."""
    folder = _scratch(spark)
    q = (out.writeStream.outputMode("append").format("parquet").option("path", folder + "/rows")
         .option("checkpointLocation", folder + "/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(folder + "/rows")


@query("stream_audit_counts", """
WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS type, count(*) AS events FROM events GROUP BY 1, 2)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, type, events FROM w
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_audit_counts(spark, sf):
    log = _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"))
    return _drain(spark, J.audit_counts(log))


@query("audit_counts_sliding", """
WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - o * INTERVAL 30 MINUTE AS window_start, event_type AS type FROM events, (SELECT unnest([0, 1]) AS o))
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, type, count(*) AS events FROM w GROUP BY 1, 2, 3""")
def audit_counts_sliding(spark, sf):
    log = I.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"))
    return J.audit_counts(log, "1 hour", "30 minutes")


SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS turns FROM s GROUP BY user_id, no"""


def _turns(df):
    return df.select(F.col("ts").cast("timestamp").alias("ts"), "user_id")


@query("session_activity", SESSIONS)
def session_activity(spark, sf):
    return J.session_activity(_turns(I.table(spark, sf, "events")))


@query("stream_session_activity", f"SELECT * FROM ({SESSIONS}) WHERE session_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_session_activity(spark, sf):
    return _drain(spark, J.session_activity(_turns(_stream(spark, sf, "events"))))


@query("stream_graph_delta", "SELECT DISTINCT user_id AS source, event_type AS target FROM events")
def stream_graph_delta(spark, sf):
    e = _stream(spark, sf, "events").select(F.col("user_id").alias("source"), F.col("event_type").alias("target"), F.col("ts").cast("timestamp").alias("seen_at"))
    folder = _scratch(spark)
    J.graph_delta_stream(e, ["source", "target"], folder + "/rows", folder + "/state").awaitTermination()
    return spark.read.schema(e.schema).parquet(folder + "/rows").select("source", "target")


@query("stream_dedup", "SELECT md5(text) AS content_md5, arg_min('doc' || doc_id, 'doc' || doc_id) AS doc_name FROM documents GROUP BY 1")
def stream_dedup(spark, sf):
    d = _stream(spark, sf, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_name"),
                                              F.lit(0).cast("bigint").alias("chunk_idx"), F.md5("text").alias("content_md5"))
    folder = _scratch(spark)
    J.dedup_stream(d, folder + "/rows", folder + "/state").awaitTermination()
    return spark.read.parquet(folder + "/rows").select("content_md5", "doc_name")


TASK_EVENT = ("CASE event_type WHEN 'view' THEN 'parse_start' WHEN 'signup' THEN 'parse_done' WHEN 'click' THEN 'index_start' "
              "WHEN 'purchase' THEN 'graph_ok' ELSE 'cancel' END")


# one task's events in order, step by step: s is the state, since its start, out what the event changed
LIMIT = "(CASE s WHEN 'parsing' THEN 600 WHEN 'chunking' THEN 300 WHEN 'indexing' THEN 300 END)"
LIFECYCLE = f"""
WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS task_uuid, {TASK_EVENT} AS event, ts,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, {TASK_EVENT}) AS i FROM events),
walk AS (
  SELECT task_uuid, 0::BIGINT AS i, 'received' AS s, NULL::TIMESTAMP AS since, NULL::VARCHAR AS was, NULL::VARCHAR AS reason, NULL::TIMESTAMP AS "at"
  FROM (SELECT DISTINCT task_uuid FROM e)
  UNION ALL
  SELECT task_uuid, i, new, CASE WHEN new <> s THEN ts ELSE since END, CASE WHEN new <> s THEN s END,
    CASE WHEN new = s OR new <> 'failed' THEN NULL WHEN late THEN 'timeout' ELSE 'cancelled' END, ts
  FROM (SELECT *, CASE WHEN s IN ('done', 'partial', 'failed') THEN s WHEN late OR event = 'cancel' THEN 'failed'
      WHEN s = 'received' AND event = 'parse_start' THEN 'parsing' WHEN s = 'parsing' AND event = 'parse_done' THEN 'chunking'
      WHEN s = 'chunking' AND event = 'index_start' THEN 'indexing' WHEN s = 'indexing' AND event = 'graph_ok' THEN 'done' ELSE s END AS new
    FROM (SELECT w.task_uuid, e.i, e.event, e.ts, w.s, w.since, coalesce(epoch(e.ts) - epoch(w.since) > {LIMIT}, false) AS late
      FROM walk w JOIN e ON e.task_uuid = w.task_uuid AND e.i = w.i + 1))),
final AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY task_uuid ORDER BY i DESC) = 1),
mark AS (SELECT max(ts) - INTERVAL 10 MINUTE AS m FROM events)
SELECT task_uuid, was AS from_state, s AS to_state, "at", reason FROM walk WHERE was IS NOT NULL
UNION ALL SELECT task_uuid, s, 'failed', since + INTERVAL 1 SECOND * {LIMIT}, 'timeout' FROM final, mark
WHERE {LIMIT} IS NOT NULL AND since + INTERVAL 1 SECOND * {LIMIT} < m"""


@query("stream_task_lifecycle", LIFECYCLE)
def stream_task_lifecycle(spark, sf):
    e = _stream(spark, sf, "events").select(F.col("user_id").cast("string").alias("task_uuid"), F.expr(TASK_EVENT).alias("event"),
                                           F.col("ts").cast("timestamp").alias("ts"))
    return _drain(spark, J.task_lifecycle(e, retention_ms=365 * 86_400_000))


@query("stream_ingest", "WITH " + I.ITEMS + f""", t AS (SELECT doc_name, item_idx AS chunk_idx, {I.sql_strip('text')} AS text FROM items WHERE type = 'text'),
g AS (SELECT *, md5(text) AS content_md5 FROM t WHERE length(text) > 30 AND {I.sql_noise('text')} <= 0.5 AND NOT {I.sql_loop('text')})
SELECT doc_name, chunk_idx, content_md5 FROM (SELECT *, row_number() OVER (PARTITION BY content_md5 ORDER BY doc_name, chunk_idx) AS rn FROM g) WHERE rn = 1""")
def stream_ingest(spark, sf):
    """Content lists written by one job, picked up by the stream in one batch."""
    items = I.items(spark, sf).where(F.col("type") == "text").select("doc_name", "item_idx", "type", "text", "page_idx")
    # one JSON array per document, at its item positions; a document's items are one cell already in the table
    listed = items.groupBy("doc_name").agg(F.array_sort(F.collect_list(F.struct("item_idx", "type", "text", "page_idx"))).alias("a"))
    files = listed.select(F.concat(F.col("doc_name"), F.lit("_content_list.json")).alias("file_name"),
                          F.transform("a", lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text"), x["page_idx"].alias("page_idx"),
                                                              x["item_idx"].cast("string").alias("img_path"))).alias("a"))
    folder = _scratch(spark)
    files.select("file_name", F.to_json("a").alias("value")).write.parquet(folder + "/files")
    source = spark.readStream.schema("file_name string, value string").parquet(folder + "/files")
    q = source.writeStream.foreachBatch(J.ingest_batch(folder + "/kb", 8)).option("checkpointLocation", folder + "/state").trigger(
        availableNow=True).start()
    q.awaitTermination()
    order = listed.select("doc_name", F.posexplode("a").alias("pos", "x")).select("doc_name", F.col("pos").cast("bigint").alias("chunk_idx"), "x.item_idx")
    kb = load_kb(spark, folder + "/kb").select("doc_name", "chunk_idx", "content_md5")
    return kb.join(order, ["doc_name", "chunk_idx"]).select("doc_name", F.col("item_idx").alias("chunk_idx"), "content_md5")


def _in_waves(spark: SparkSession, waves: list[DataFrame], run) -> None:
    """Each wave of rows arrives as files of its own, then ``run(stream)`` works up what is new; its files go when it is done."""
    folder = _scratch(spark)
    for wave in waves:
        wave.write.mode("append").option("compression", "zstd").parquet(folder)
        free_shuffles(spark)
        run(spark.readStream.schema(wave.schema).parquet(folder)).awaitTermination()
        forget(spark, [folder])
        free_shuffles(spark)


def _content_lists(items: DataFrame) -> DataFrame:
    """One file of a document's items, all kinds, in their order; a document's items are one cell already in the table."""
    fields = ["type", "text", "page_idx", "image_caption", "table_caption", "table_body", "img_path"]
    listed = F.array_sort(F.collect_list(F.struct("item_idx", F.struct(*fields).alias("x"))))
    return items.groupBy("doc_name").agg(F.to_json(F.transform(listed, lambda i: i["x"])).alias("value")).select(
        F.concat(F.col("doc_name"), F.lit("_content_list.json")).alias("file_name"), "value")


# documents arrive by two waves; new versions of four documents in five by a third
IN_TURN = I.CHUNKS.replace("PARTITION BY content_md5 ORDER BY doc_name", f"PARTITION BY content_md5 ORDER BY {NUMBER} % 2, doc_name")


@query("stream_ingest_batches", "WITH " + upserted(versions(IN_TURN, f"{NUMBER} % 5 <> 0")) + STATE)
def stream_ingest_batches(spark, sf):
    """Texts, images and tables through three batches of one stream, versions that replace stored ones included."""
    items, new, number = I.items(spark, sf), new_items(spark, sf), F.expr(NUMBER)
    waves = [_content_lists(x) for x in (items.where(number % 2 == 0), items.where(number % 2 == 1), new.where(number % 5 != 0))]
    folder = _scratch(spark)
    _in_waves(spark, waves, lambda files: files.writeStream.foreachBatch(J.ingest_batch(folder + "/kb", 8)).option(
        "checkpointLocation", folder + "/state").trigger(availableNow=True).start())
    return load_kb(spark, folder + "/kb").select("doc_name", "chunk_idx", "type", "content_md5", "section_tag")


@query("stream_dedup_batches", """
SELECT md5(text) AS content_md5, arg_min('doc' || doc_id, struct_pack(a := doc_id % 4, b := 'doc' || doc_id)) AS doc_name FROM documents GROUP BY 1""")
def stream_dedup_batches(spark, sf):
    d = I.table(spark, sf, "documents")
    rows = d.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_name"), F.lit(0).cast("bigint").alias("chunk_idx"),
                    F.md5("text").alias("content_md5"))
    folder = _scratch(spark)
    waves = [rows.where(d["doc_id"] % 4 == w) for w in range(4)]
    _in_waves(spark, waves, lambda chunks: J.dedup_stream(chunks, folder + "/rows", folder + "/state", parts=16))
    return spark.read.parquet(folder + "/rows").select("content_md5", "doc_name")


@query("stream_graph_delta_batches", "SELECT user_id AS source, event_type AS target, min(event_id % 5) AS wave FROM events GROUP BY ALL")
def stream_graph_delta_batches(spark, sf):
    """An edge comes out of the first wave that holds it."""
    e = I.table(spark, sf, "events").select(F.col("user_id").alias("source"), F.col("event_type").alias("target"), (F.col("event_id") % 5).alias("wave"))
    folder = _scratch(spark)
    _in_waves(spark, [e.where(F.col("wave") == w) for w in range(5)],
              lambda rows: J.graph_delta_stream(rows, ["source", "target"], folder + "/rows", folder + "/state"))
    return spark.read.schema(e.schema).parquet(folder + "/rows")


def _upper(c: str) -> str:
    """Upper case of one character by one character, as SQL has it: ``str.upper`` makes two of some, such as SS."""
    return next((u for u in (c.upper(), c.title()) if len(u) == 1), "\u1e9e" if c == "\u00df" else c)


def _flaky(prompt: str) -> str:
    if "a" in prompt[:1].lower():
        raise RuntimeError("model down")
    return "".join(map(_upper, prompt[:5]))


@query("model_map", """
SELECT item_id, true AS success, CASE WHEN lower(left(text, 1)) = 'a' THEN length(text)::VARCHAR ELSE upper(left(text, 5)) END AS data,
 CASE WHEN lower(left(text, 1)) = 'a' THEN 'second' ELSE 'first' END AS model, lower(left(text, 1)) = 'a' AS fallback FROM benchmark""")
def model_map(spark, sf):
    b = I.table(spark, sf, "benchmark")
    chain = [("first", _flaky), ("second", lambda p: str(len(p)))]
    return MM.model_map(b, "text", "item_id", chain, retries=1, base=0.0).select("item_id", "success", "data", "model", "fallback")
