"""Writers: the chunk table, parsed items, reports, dead letters and audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from marginalia.operators import incremental
from marginalia.operators.ingest import offered_chunks
from marginalia.session import folder_bytes, forget, free_shuffles, written
from marginalia.sources import schemas as S
from marginalia.sources.batch_log import PARTS, BatchLog, Table

# ---- fixed values: audit events with their fields; text cut to the given length -----------
AUDIT_EVENTS = {
    "upload": ["uuid", "filename", "size", "md5"],
    "parse_start": ["uuid", "filename", "engine"],
    "parse_page": ["uuid", "page", "chars", "duration_ms"],
    "parse_done": ["uuid", "chunks", "hallucinated", "duration_ms", "pico_types"],
    "pico_classify": ["uuid", "chunks", "api"],
    "docling_images": ["uuid", "images", "duration_ms"],
    "faiss_start": ["uuid", "vectors_before"],
    "faiss_done": ["uuid", "vectors_added", "vectors_after", "duration_ms"],
    "faiss_encode": ["chunks", "duration_ms", "device"],
    "mysql_sync": ["uuid", "article_id", "segments", "figures"],
    "lightrag_start": ["uuid", "mode"],
    "lightrag_done": ["uuid", "entities", "relations", "duration_ms"],
    "graph_build": ["nodes", "edges"],
    "agent_query": ["question", "model"],
    "agent_step": ["step", "tool", "elapsed", "preview"],
    "agent_answer": ["steps", "elapsed", "citations", "model"],
    "agent_fallback": ["reason"],
    "agent_error": ["error", "step"],
    "login": ["username", "success", "ip"],
    "logout": ["username"],
    "api": ["method", "path", "status", "duration_ms"],
    "error": ["component", "error", "context"],
    "system_startup": ["pid"],
    "system_shutdown": [],
    "system_health": [],
}
AUDIT_CUT = {("agent_query", "question"): 120, ("agent_step", "preview"): 200,
             ("agent_fallback", "reason"): 200, ("agent_error", "error"): 300, ("error", "error"): 500}
UUID_CUT = 12
AUDIT_DEFAULTS = {("parse_start", "engine"): '"mineru25pro"', ("agent_step", "preview"): '""',
                  ("agent_error", "step"): "0", ("error", "context"): "{}"}  # as JSON
PLACEHOLDER = "[解析失败] "
# -------------------------------------------------------------------------------------------

#: A batch of more bytes, as its parsed items lie on disk, is written in slices of about as many.
SLICE_BYTES = 16_000_000


def kb_log(spark: SparkSession, folder: str, parts: int = PARTS) -> BatchLog:
    """The stored knowledge base: chunks by document, and an index of their hashes by hash."""
    return BatchLog(spark, folder, [
        Table("chunks", S.CHUNKS, ("doc_name", "content_md5"), ("doc_name",)),
        Table("hashes", "content_md5 string, doc_name string", ("content_md5", "doc_name"), ("content_md5",))], parts)


def save_kb(chunks: DataFrame, folder: str, buckets: int = PARTS) -> None:
    """Make ``chunks`` the whole stored table; readers see the old one until the new one is complete."""
    log = kb_log(chunks.sparkSession, folder, buckets)
    rows = chunks.select(*[f.split()[0] for f in S.CHUNKS.split(", ")])
    log.replace({"chunks": rows, "hashes": rows.select("content_md5", "doc_name")})


def upsert_kb(log: BatchLog, items: DataFrame, stream: str = "", batch_id: int = 0) -> None:
    """(Re-)ingest documents into the stored table as one batch: what changes is appended, nothing rewritten.

    Reads the partitions of the documents, and of the hash index those of the hashes offered. A batch
    that is committed already is left alone; one that was cut short is written anew.
    """
    if log.holds(stream, batch_id):
        return
    spark, paths = items.sparkSession, []
    try:
        # parsed once: hashes, places and the texts of what is added all come from here
        offered = written(offered_chunks(items), paths)
        parts = log.parts_of(offered, "doc_name")
        near = log.live("chunks", parts)
        arriving = offered.where(F.col("text").isNotNull()).select("content_md5").distinct()
        known = log.live("hashes", log.parts_of(arriving, "content_md5")).join(arriving, "content_md5", "left_semi").join(
            offered.select("doc_name").distinct(), "doc_name", "left_anti")
        changes, candidates = incremental.offered_changes(near, offered, known, paths)
        free_shuffles(spark)
        ended = changes.where(F.col("kind") == "change")
        moved = not ended.where(F.col("stays").isNotNull()).isEmpty()  # else no stored text is read
        # texts of a large batch are shuffled a slice of the partitions at a time, and what a slice shuffled goes before the next
        slices = max(1, min(log.parts, folder_bytes(spark, paths[0]) // SLICE_BYTES))
        for n in range(slices):
            mine = F.pmod(log.part("doc_name"), F.lit(slices)) == n
            added = incremental.added_rows(candidates.where(mine), changes.where(mine)).select(*near.columns)
            if moved:
                stored = log.live("chunks", [p for p in parts if p % slices == n])
                added = added.unionByName(incremental.changed_rows(stored, ended.where(mine), only=True))
            log.write("chunks", added, ended.where(mine), more=n > 0)
            free_shuffles(spark)
        new = log.written("chunks")
        log.write("hashes", new.where("_alive"), new.where("NOT _alive"))
        log.commit(stream, batch_id)
    finally:
        forget(spark, paths)


def write_items(items: DataFrame, folder: str) -> None:
    """Content items as JSON lines; order is a column, so no document is gathered to be written."""
    items.write.mode("overwrite").json(folder)


def write_pages(page_texts: DataFrame, folder: str) -> None:
    page_texts.write.mode("overwrite").parquet(folder)


def write_report(report: DataFrame, folder: str) -> None:
    """A report (a handful of rows) as JSON text."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(folder)


def write_dead_letters(bad: DataFrame, folder: str) -> None:
    bad.write.mode("append").json(folder)


def placeholder_items(bad: DataFrame) -> DataFrame:
    """A text item in place of every file that could not be parsed."""
    base = F.regexp_extract("file", r"([^/\\]*)$", 1)
    return bad.select(base.alias("doc_name"), F.lit(0).cast("bigint").alias("item_idx"), F.lit("text").alias("type"),
                      F.concat(F.lit(PLACEHOLDER), base, F.lit(": "), F.left("error", F.lit(200))).alias("text"),
                      F.lit(0).cast("bigint").alias("page_idx"))


def audit_rows(events: DataFrame, event_type: str, at: Column | None = None) -> DataFrame:
    """JSON lines of one audit event type, from columns named like its fields."""
    fields = AUDIT_EVENTS[event_type]
    missing = [f for f in fields if f not in events.columns and (event_type, f) not in AUDIT_DEFAULTS]
    if missing:
        raise ValueError(f"audit event {event_type} lacks: {', '.join(missing)}")

    def value(f: str) -> Column:
        if f not in events.columns:
            return F.parse_json(F.lit(AUDIT_DEFAULTS[event_type, f])).alias(f)
        cut = _cut(event_type, f)
        return (F.left(F.col(f), F.lit(cut)) if cut else F.col(f)).alias(f)

    return events.select(F.to_json(F.struct(_audit_time(at if at is not None else F.current_timestamp()), F.lit(event_type).alias("type"),
                                            *[value(f) for f in fields])).alias("value"))


def _cut(event_type: str, field: str) -> int | None:
    return UUID_CUT if field == "uuid" else AUDIT_CUT.get((event_type, field))


def _audit_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts")


def audit_lines(log: DataFrame) -> DataFrame:
    """JSON lines of a log of mixed events, batch or stream: ``(ts, type, payload)``, the payload JSON text or a variant.

    Each type takes its own fields from the payload, in order, with their JSON types; long texts are
    cut, missing fields take their default or stay out. Rows of other types are left out. ``log``'s
    other columns are kept.
    """
    given = F.col("payload")
    payload = given if isinstance(log.schema["payload"].dataType, ST.VariantType) else F.try_parse_json(given)

    def value(kind: str, f: str) -> Column:
        path, cut = f"$.{f}", _cut(kind, f)
        found = F.try_variant_get(F.col("_v"), path, "string" if cut else "variant")
        if cut:
            found = F.to_variant_object(F.array(F.left(found, F.lit(cut))))
            found = F.when(F.try_variant_get(F.col("_v"), path, "string").isNotNull(), F.try_variant_get(found, "$[0]", "variant"))
        default = AUDIT_DEFAULTS.get((kind, f))
        return (F.coalesce(found, F.parse_json(F.lit(default))) if default else found).alias(f)

    line = None
    for kind, fields in AUDIT_EVENTS.items():
        whole = F.to_json(F.struct(_audit_time(F.col("ts")), F.col("type"), *[value(kind, f) for f in fields]))
        line = F.when(F.col("type") == kind, whole) if line is None else line.when(F.col("type") == kind, whole)
    return log.where(F.col("type").isin(*AUDIT_EVENTS)).withColumn("_v", payload).withColumn("value", line).drop("_v", "payload", "ts", "type")


def append_audit(events: DataFrame, event_type: str, folder: str) -> None:
    audit_rows(events, event_type).write.mode("append").text(folder)
