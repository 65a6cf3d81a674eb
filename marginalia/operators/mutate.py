"""Row changes as table rewrites: new state out, persisted by overwriting what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.keyed import global_row_number

# ---- fixed values: states and the columns a task update may set ---------------------------
ARTICLE_STATES = ["pending", "parsing", "parsed", "reviewing", "approved", "rejected", "error"]
TASK_STATES = ["received", "parsing", "chunking", "indexing", "cross_validating", "postprocessing",
               "indexing_faiss", "indexing_lightrag", "done", "failed", "partial"]
TASK_COLUMNS = [
    "status", "parsing_duration_ms", "engine_selected", "engine_reason", "cross_validation_scores",
    "quality_warning", "faiss_status", "faiss_duration_ms", "faiss_chunks_before",
    "faiss_chunks_added", "faiss_is_update", "faiss_error", "faiss_images_total",
    "faiss_images_vlm", "faiss_started_at", "lightrag_status", "lightrag_duration_ms",
    "lightrag_mode", "lightrag_entities", "lightrag_relations", "lightrag_error",
    "lightrag_started_at", "updated_at"]
# -------------------------------------------------------------------------------------------


def _latest(changes: DataFrame, key: str, at: str) -> DataFrame:
    """One change per key, the latest, of equally late ones the largest row; an aggregate, so repeated
    changes combine early."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("_c")).select(
        key, *[F.col("_c")[c].alias(f"_{c}") for c in rest])


def set_article_status(articles: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``changes(article_id, status, changed_at)``: parsed and approved set their stamps,
    approved also puts the article into the knowledge base."""
    out = articles.join(_latest(changes, "article_id", "changed_at"), "article_id", "left")
    new = F.col("_status")
    return (out.withColumn("parsed_at", F.when(new == "parsed", F.col("_changed_at")).otherwise(F.col("parsed_at")))
            .withColumn("approved_at", F.when(new == "approved", F.col("_changed_at")).otherwise(F.col("approved_at")))
            .withColumn("is_in_knowledge_base", F.when(new == "approved", True).otherwise(F.col("is_in_knowledge_base")))
            .withColumn("status", F.coalesce(new, "status")).drop("_status", "_changed_at"))


def update_tasks(tasks: DataFrame, changes: DataFrame, at: str = "updated_at") -> DataFrame:
    """Apply task changes; a column outside the white list is an error before any work starts."""
    bad = [c for c in changes.columns if c != "task_uuid" and c not in TASK_COLUMNS]
    if bad:
        raise ValueError(f"not an updatable task column: {', '.join(bad)}")
    out = tasks.join(_latest(changes, "task_uuid", at), "task_uuid", "left")
    for c in changes.columns:
        if c != "task_uuid":
            out = out.withColumn(c, F.coalesce(f"_{c}", c) if c in tasks.columns else F.col(f"_{c}")).drop(f"_{c}")
    return out


def cascade_delete(gone: DataFrame, key: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted keys."""
    ids = gone.select(key).distinct()
    return {name: df.join(ids, key, "left_anti") for name, df in tables.items()}


def retry_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks with the verdict of a retry request and, where granted, their reset state."""
    retries = F.coalesce("retry_count", F.lit(0)) + 1
    verdict = (F.when(~F.col("status").isin("failed", "partial"), "not_retryable")
               .when(retries > F.coalesce("max_retries", F.lit(3)), "limit_reached").otherwise("re-enqueued"))
    t = tasks.withColumn("verdict", verdict)
    ok = F.col("verdict") == "re-enqueued"
    return (t.withColumn("retry_count", F.when(ok, retries).otherwise(F.col("retry_count")))
            .withColumn("status", F.when(ok, "received").otherwise(F.col("status")))
            .withColumn("faiss_status", F.when(ok, "pending").otherwise(F.col("faiss_status")))
            .withColumn("lightrag_status", F.when(ok, "pending").otherwise(F.col("lightrag_status"))))


def recount(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """A parent's child count from the child rows; recomputed, never incremented."""
    n = children.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    base = parents.drop(name)
    return base.join(n, key, "left").withColumn(name, F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_n")


def rate_messages(messages: DataFrame, ratings: DataFrame) -> DataFrame:
    """Last rating and feedback per message win; ``ratings(message_id, rating, feedback, rated_at)``."""
    r = _latest(ratings, "message_id", "rated_at")
    return (messages.drop("rating", "feedback").join(r, "message_id", "left")
            .withColumnRenamed("_rating", "rating").withColumnRenamed("_feedback", "feedback").drop("_rated_at"))


def append_rows(table: DataFrame, fresh: DataFrame, id_column: str, order: list[str],
                defaults: dict[str, Column]) -> DataFrame:
    """Append rows with defaults for absent values and ids continuing the stored ones.

    Runs one job for the id assignment.
    """
    for name, value in defaults.items():
        fresh = fresh.withColumn(name, F.coalesce(F.col(name), value) if name in fresh.columns else value)
    next_id = table.agg((F.coalesce(F.max(id_column), F.lit(0)) + 1).alias("n")).scalar()
    rows = global_row_number(fresh, order, 0, "_no").withColumn(id_column, (F.col("_no") + next_id).cast("bigint"))
    return table.unionByName(rows.select(*table.columns))
