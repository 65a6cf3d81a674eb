"""Statistics over the knowledge base and its operational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.operators.keyed import top_n_per_key, with_position
from marginalia.operators.lookups import containments


def count(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def kb_stats(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: chunks, documents, vectors, dimension."""
    c = chunks.agg(count("total_chunks"), F.count_distinct("doc_name").alias("total_documents"))
    v = vectors.agg(count("vectors"), F.max(F.size("embedding")).cast("bigint").alias("embedding_dim"))
    return _side_by_side(c, v)


def _side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row aggregates as one row (joined on a constant; every side is exactly one row)."""
    out = rows[0].withColumn("_one", F.lit(1))
    for r in rows[1:]:
        out = out.join(F.broadcast(r.withColumn("_one", F.lit(1))), "_one")
    return out.drop("_one")


def list_docs(chunks: DataFrame) -> DataFrame:
    """Chunk count and sorted page list per document; pages fold to distinct ones first."""
    pages = chunks.groupBy("doc_name", "page_idx").agg(count("_n"))
    return pages.groupBy("doc_name").agg(F.sum("_n").alias("chunks"),
                                         F.array_sort(F.collect_list("page_idx")).alias("pages"))


def document_profile(chunks: DataFrame, top: int = 4) -> DataFrame:
    """Chunks per document and section tag, ranked; ``in_top`` marks the four shown first."""
    h = chunks.groupBy("doc_name", F.coalesce("section_tag", F.lit("unknown")).alias("section_tag")).agg(count("chunks"))
    w = W.partitionBy("doc_name").orderBy(F.col("chunks").desc(), "section_tag")
    return h.withColumn("tag_rank", F.row_number().over(w)).withColumn("in_top", F.col("tag_rank") <= top)


def document_coverage(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Chunks, content types and pages of the documents matching each asked name (any case).

    ``names(asked)``; matches come from the containment join of ``lookups``. Names nobody matches are reported as not found.
    """
    per_doc = chunks.groupBy("doc_name").agg(
        count("chunks"), F.array_sort(F.collect_set("type")).alias("types"),
        F.count_distinct("page_idx").alias("pages"))
    asked = names.select("asked", F.lower("asked").alias("_stem")).distinct()
    low = per_doc.withColumn("_name", F.lower("doc_name"))
    pairs = containments(asked, low)
    parts = low.join(pairs, "_name")
    found = parts.join(asked, "_stem").groupBy("asked").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("chunks").alias("chunks"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"),
        F.sum("pages").alias("pages"))
    return names.select("asked").distinct().join(found, "asked", "left").withColumn(
        "found", F.col("documents").isNotNull())


def document_exists(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Whether a file of exactly this name is indexed, and its chunks; ``names(file_name)``."""
    n = names.select("file_name", F.replace("file_name", F.lit(".pdf"), F.lit("")).alias("doc_name")).distinct()
    per = chunks.groupBy("doc_name").agg(count("_n"))
    return n.join(per, "doc_name", "left").select(
        "file_name", "doc_name", F.col("_n").isNotNull().alias("exists"), F.coalesce("_n", F.lit(0)).cast("bigint").alias("chunk_count"))


def article_filter(articles: DataFrame, status: str | None = None, search: str | None = None,
                   article_type: str | None = None, department: str | None = None, limit: int = 50) -> DataFrame:
    """Newest articles matching the given filters."""
    out = articles
    for column, value in (("status", status), ("article_type", article_type), ("department", department)):
        if value:
            out = out.where(F.col(column) == value)
    if search:
        out = out.where(F.col("title").contains(search))
    return out.orderBy(F.col("uploaded_at").desc(), F.col("article_id").desc()).limit(limit)


def task_filter(tasks: DataFrame, status: str | None = None, uploaded_by: str | None = None,
                limit: int = 50) -> DataFrame:
    """Newest upload tasks matching the given filters."""
    out = tasks
    for column, value in (("status", status), ("uploaded_by", uploaded_by)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.orderBy(F.col("created_at").desc(), F.col("task_uuid").desc()).limit(limit)


def article_stats(articles: DataFrame) -> DataFrame:
    """Articles per status with totals, as ``(kind, name, n)`` rows, in one aggregation."""
    g = articles.groupBy("status").agg(count("n"), F.count_if("is_in_knowledge_base").alias("kb"))
    by = g.select(F.lit("status").alias("kind"), F.col("status").alias("name"), "n")
    tot = g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("kb"), F.lit(0)).alias("kb"))
    both = tot.select(F.inline(F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("articles").alias("name"), F.col("total").alias("n")),
        F.struct(F.lit("total").alias("kind"), F.lit("in_knowledge_base").alias("name"), F.col("kb").alias("n")))))
    return by.unionByName(both)


DEFAULT_PARSE_SECONDS = 12.5


def system_stats(articles: DataFrame, sessions: DataFrame, messages: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row of table counts and the mean parse time of finished tasks (12.5 s without any)."""
    a = articles.agg(count("total_articles"), F.count_if(F.col("status") == "parsed").alias("parsed_articles"),
                     F.count_if("is_in_knowledge_base").alias("knowledge_base_articles"))
    finished = F.col("status").isin("done", "partial")
    t = tasks.agg(F.coalesce(F.round(F.avg(F.when(finished, F.col("parsing_duration_ms"))) / 1000, 1),
                             F.lit(DEFAULT_PARSE_SECONDS)).alias("avg_parse_seconds"))
    return _side_by_side(a, sessions.agg(count("chat_sessions")), messages.agg(count("chat_messages")), t)


def recent_operations(log: DataFrame, n: int = 5) -> DataFrame:
    return log.orderBy(F.col("created_at").desc(), F.col("log_id").desc()).limit(n)


def latest_feedback(feedback: DataFrame, kept: int = 500) -> DataFrame:
    """The newest ratings, for stores that hold no more than so many."""
    return feedback.orderBy(F.col("created_at").desc(), F.col("feedback_id").desc()).limit(kept)


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Helpful share of all ratings."""
    good = F.count_if(F.col("rating") == "helpful")
    s = feedback.agg(count("total"), good.alias("helpful"))
    return s.select("total", "helpful", (F.col("total") - F.col("helpful")).alias("not_helpful"),
                    F.when(F.col("total") > 0, F.round(F.col("helpful") / F.col("total") * 100, 1))
                    .otherwise(0.0).alias("rate"))


def recent_feedback(feedback: DataFrame, n: int = 10) -> DataFrame:
    return feedback.orderBy(F.col("created_at").desc(), F.col("feedback_id").desc()).limit(n)


def state_distribution(tasks: DataFrame) -> DataFrame:
    """Tasks per state; received and parsing ones count as stuck."""
    return tasks.groupBy("status").agg(count("tasks")).withColumn(
        "stuck", F.when(F.col("status").isin("received", "parsing"), F.col("tasks")).otherwise(0).cast("bigint"))


def field_completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """Missing values per required field, in one pass over the table."""
    sums = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in fields])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in fields])))


def monthly_trends(articles: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per month: uploads, parsed, approved, chats; months in between without rows show zeros."""
    def month(c: str) -> Column:
        return F.trunc(F.col(c).cast("date"), "month")

    a = articles.groupBy(month("uploaded_at").alias("month")).agg(
        count("uploads"), F.count_if(F.col("status").isin("parsed", "reviewing", "approved")).alias("parsed"),
        F.count_if(F.col("status") == "approved").alias("approved"))
    c = sessions.groupBy(month("created_at").alias("month")).agg(count("chats"))
    seen = a.select("month").unionByName(c.select("month"))
    calendar = seen.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).where(F.col("lo").isNotNull()).select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    z = lambda n: F.coalesce(n, F.lit(0)).cast("bigint").alias(n)
    return calendar.join(a, "month", "left").join(c, "month", "left").select(
        F.date_format("month", "yyyy-MM").alias("month"), z("uploads"), z("parsed"), z("approved"), z("chats"))


def department_distribution(articles: DataFrame) -> DataFrame:
    return articles.groupBy("department").agg(count("articles"))


def image_stats(chunks: DataFrame) -> DataFrame:
    """Images and analysed images per document."""
    image = F.col("type").isin("image", "chart")
    return chunks.groupBy("doc_name").agg(F.count_if(image).alias("images_total"),
                                          F.count_if(image & F.col("vlm_analyzed")).alias("images_analysed"))


def session_message_counts(messages: DataFrame) -> DataFrame:
    """Messages and last activity per session."""
    return messages.groupBy("session_id").agg(count("messages"), F.max("created_at").alias("updated_at"))


def session_history(messages: DataFrame) -> DataFrame:
    """Messages in order with their place in the session."""
    return with_position(messages, ["session_id"], "message_no", "position")


def latency_report(calls: DataFrame, keys: list[str], value: str = "duration_ms") -> DataFrame:
    """Calls, min, median and max per key.

    The median is exact: values are first counted per (key, value), which combines before the
    shuffle, so a key with a third of all calls leaves only its distinct durations to rank.
    """
    v = calls.groupBy(*keys, value).agg(count("_n"))
    return v.groupBy(*keys).agg(F.sum("_n").alias("calls"), F.min(value).alias("min"),
                                F.expr(f"percentile({value}, 0.5, _n)").alias("median"), F.max(value).alias("max"))


def tail_by_type(log: DataFrame, n: int = 50) -> DataFrame:
    """Last ``n`` audit rows of every type."""
    return top_n_per_key(log, ["type"], [F.col("ts").desc(), F.col("event_id").desc()], n)
