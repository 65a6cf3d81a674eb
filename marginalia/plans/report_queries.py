"""Queries over statistics, quality reports and table rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import evaluate as V
from marginalia.operators import lookups as L
from marginalia.operators import mutate as M
from marginalia.operators import reports as P
from marginalia.plans import inputs as I
from marginalia.plans.registry import query
from marginalia.plans.text_queries import SCORED

# ---- knowledge base -----------------------------------------------------------------------


@query("kb_stats", "WITH " + I.CHUNKS + """
SELECT count(*) AS total_chunks, count(DISTINCT doc_name) AS total_documents, (SELECT count(*) FROM embeddings) AS vectors,
  (SELECT max(len(embedding)) FROM embeddings) AS embedding_dim FROM chunks""")
def kb_stats(spark, sf):
    return P.kb_stats(I.chunks(spark, sf), I.vectors(spark, sf))


@query("list_docs", "WITH " + I.CHUNKS + """
SELECT doc_name, count(*) AS chunks, array_to_string(list_sort(list_distinct(list(page_idx))), '|') AS pages FROM chunks GROUP BY doc_name""")
def list_docs(spark, sf):
    return P.list_docs(I.chunks(spark, sf))


PROFILE = "WITH " + I.CHUNKS + """, h AS (SELECT doc_name, coalesce(section_tag, 'unknown') AS section_tag, count(*) AS chunks FROM chunks GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_name ORDER BY chunks DESC, section_tag) AS tag_rank FROM h)
SELECT *, tag_rank <= 4 AS in_top FROM r"""


@query("document_profile", PROFILE)
def document_profile(spark, sf):
    return P.document_profile(I.chunks(spark, sf))


@query("document_coverage", "WITH " + I.CHUNKS + """, names AS (SELECT DISTINCT upper('doc' || (doc_id // 10)) AS asked FROM documents),
d AS (SELECT doc_name, count(*) AS chunks, list(DISTINCT type) AS types, count(DISTINCT page_idx) AS pages FROM chunks GROUP BY doc_name)
SELECT asked, CASE WHEN count(d.doc_name) > 0 THEN count(d.doc_name) END AS documents, sum(chunks)::BIGINT AS chunks,
  array_to_string(list_sort(list_distinct(flatten(list(types)))), '|') AS types, sum(pages)::BIGINT AS pages, count(d.doc_name) > 0 AS found
FROM names LEFT JOIN d ON contains(lower(d.doc_name), lower(asked)) GROUP BY asked""")
def document_coverage(spark, sf):
    names = I.text_table(spark, sf, "documents").select(
        F.concat(F.lit("DOC"), F.floor(F.col("doc_id") / 10).cast("string")).alias("asked"))
    return P.document_coverage(I.chunks(spark, sf), names)


@query("document_exists", "WITH " + I.CHUNKS + """, f AS (SELECT DISTINCT CASE WHEN lang = 'en' THEN 'doc' ELSE 'paper' END || doc_id || '.pdf' AS file_name FROM documents),
n AS (SELECT doc_name, count(*) AS n FROM chunks GROUP BY doc_name)
SELECT file_name, replace(file_name, '.pdf', '') AS doc_name, n IS NOT NULL AS exists, coalesce(n, 0) AS chunk_count FROM f LEFT JOIN n ON n.doc_name = replace(file_name, '.pdf', '')""")
def document_exists(spark, sf):
    d = I.table(spark, sf, "documents")
    stem = F.when(F.col("lang") == "en", "doc").otherwise("paper")
    return P.document_exists(I.chunks(spark, sf), d.select(F.concat(stem, F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_name")))


@query("chunking_quality", "WITH " + I.CHUNKS + """, t AS (SELECT coalesce(section_tag, 'unknown') AS section_group, section_tag IS NOT NULL AS tg, length(text) AS n FROM chunks)
SELECT section_group, count(*) AS total_chunks, sum(n)::BIGINT // count(*) AS avg_chunk_length, round(count(*) FILTER (tg) / count(*), 6) AS semantic_integrity,
  0.0::DOUBLE AS pico_completeness FROM t GROUP BY ROLLUP (section_group)""")
def chunking_quality(spark, sf):
    return V.chunking_quality(I.chunks(spark, sf))


@query("chunking_comparison", "WITH " + I.CHUNKS + """, o AS (SELECT doc_name, section_tag, length(text) AS n,
  coalesce(sum(length(text)) OVER (PARTITION BY doc_name ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  row_number() OVER (PARTITION BY doc_name ORDER BY chunk_idx) AS rn, lag(section_tag) OVER (PARTITION BY doc_name ORDER BY chunk_idx) AS before FROM chunks),
c AS (SELECT count(DISTINCT (doc_name, start // 512)) AS crossing FROM o WHERE rn > 1 AND section_tag IS DISTINCT FROM before AND start % 512 <> 0),
d AS (SELECT doc_name, count(*) AS k, sum(n)::BIGINT AS chars FROM o GROUP BY doc_name)
SELECT sum(k)::BIGINT AS semantic_chunks, round(sum(chars) / sum(k), 6) AS semantic_avg_length, sum(ceil(chars / 512))::BIGINT AS fixed_chunks,
  round(sum(chars) / sum(ceil(chars / 512)), 6) AS fixed_avg_length, any_value(crossing) AS crossing_chunks,
  round(any_value(crossing) / sum(ceil(chars / 512)), 6) AS crossing_share FROM d, c""")
def chunking_comparison(spark, sf):
    return V.chunking_comparison(I.chunks(spark, sf))


ITEM_COUNTS = """count(*) AS items, count(DISTINCT page_idx) AS pages, count(*) FILTER (type = 'text') AS text_items, count(*) FILTER (type = 'table') AS table_items,
 count(*) FILTER (type = 'image') AS image_items, 0::BIGINT AS chart_items, coalesce(sum(length(text)) FILTER (type = 'text'), 0)::BIGINT AS text_chars,
 count(*) FILTER (type = 'table' AND starts_with(table_body, '<table>')) AS html, count(*) FILTER (type = 'image' AND item_idx % 2 = 0) AS captioned"""


@query("parsing_quality", "WITH " + I.ITEMS + f""", c AS (SELECT doc_name, {ITEM_COUNTS} FROM items GROUP BY doc_name)
SELECT doc_name, pages, text_items, table_items, image_items, chart_items, 0::BIGINT AS other_items, text_chars,
 round_even(text_chars / greatest(text_items, 1), 0)::BIGINT AS avg_chars_per_text,
 CASE WHEN table_items > 0 THEN round_even(html / table_items * 100, 0)::BIGINT END AS table_html_rate,
 CASE WHEN image_items > 0 THEN round_even(captioned / image_items * 100, 0)::BIGINT END AS image_caption_rate FROM c""")
def parsing_quality(spark, sf):
    return V.parsing_quality(I.items(spark, sf))


@query("parsing_scores", "WITH " + I.CHUNKS + f""", c AS (SELECT {ITEM_COUNTS}, count(DISTINCT doc_name) AS docs FROM items),
t AS (SELECT count(DISTINCT coalesce(section_tag, 'unknown')) AS tags FROM chunks),
s AS (SELECT docs, least(100, greatest(0, round_even(round_even(text_chars / greatest(text_items, 1), 0) / 200 * 100, 0)))::BIGINT AS text_extraction,
 least(100, round_even(html / greatest(table_items, 1) * 100, 0))::BIGINT AS table_structure, least(100, round_even(captioned / greatest(image_items, 1) * 100, 0))::BIGINT AS image_coverage,
 least(100, tags * 12)::BIGINT AS section_classification, least(100, round_even(pages / docs * 15, 0))::BIGINT AS layout_handling FROM c, t)
SELECT *, round_even((text_extraction + table_structure + image_coverage + section_classification + layout_handling) / 5, 0)::BIGINT AS overall FROM s""")
def parsing_scores(spark, sf):
    return V.parsing_scores(I.items(spark, sf), I.chunks(spark, sf))


@query("image_stats", "WITH " + I.CHUNKS + """
SELECT doc_name, count(*) FILTER (type = 'image') AS images_total, 0::BIGINT AS images_analysed FROM hashed GROUP BY doc_name""")
def image_stats(spark, sf):
    from marginalia.operators.ingest import items_to_chunks
    return P.image_stats(items_to_chunks(I.items(spark, sf)))


@query("competency_report", f"""
WITH r AS (SELECT lang AS category, source AS dimension, 0.5 + n_chars % 3 AS weight, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE length({SCORED}) % 100 / 10.0::DOUBLE END AS score FROM documents)
SELECT 'overall' AS kind, 'mean' AS name, round(avg(score), 6) AS score, count(score) AS cases FROM r
UNION ALL SELECT 'overall', 'weighted', round(sum(score * weight) / sum(weight) FILTER (score IS NOT NULL), 6), count(score) FROM r
UNION ALL SELECT 'category', category, round(avg(score), 6), count(score) FROM r GROUP BY category
UNION ALL SELECT 'dimension', dimension, round(avg(coalesce(score, 0)), 6), count(*) FROM r GROUP BY dimension""")
def competency_report(spark, sf):
    d = I.text_table(spark, sf, "documents")
    score = F.when(F.col("doc_id") % 9 != 0, F.length(F.expr(SCORED)) % 100 / 10.0)
    return V.competency_report(d.select(F.col("lang").alias("category"), F.col("source").alias("dimension"),
                                        (F.lit(0.5) + F.col("n_chars") % 3).alias("weight"), score.alias("score")))


# ---- business tables ----------------------------------------------------------------------
A, S, X = "WITH " + I.ARTICLES, I.SEGMENTS, I.FIGURES


@query("article_filter", A + """ SELECT article_id, title, uploaded_at FROM articles
WHERE status = 'approved' AND contains(title, 'URGENT') AND department = 'Oncology' ORDER BY uploaded_at DESC, article_id DESC LIMIT 50""")
def article_filter(spark, sf):
    return P.article_filter(I.articles(spark, sf), status="approved", search="URGENT", department="Oncology").select(
        "article_id", "title", "uploaded_at")


@query("task_filter", "WITH " + I.TASKS + " SELECT task_uuid, created_at FROM tasks WHERE status = 'failed' ORDER BY created_at DESC, task_uuid DESC LIMIT 50")
def task_filter(spark, sf):
    return P.task_filter(I.tasks(spark, sf), status="failed").select("task_uuid", "created_at")


@query("article_detail", A + "," + S + "," + X + """
SELECT a.article_id, title, status, kind, sequence, content FROM articles a LEFT JOIN (
  SELECT article_id, 'segment' AS kind, sequence, content FROM segments UNION ALL SELECT article_id, 'figure', sequence, caption FROM figures) c USING (article_id)""")
def article_detail(spark, sf):
    return L.article_detail(I.articles(spark, sf), I.segments(spark, sf), I.figures(spark, sf)).select(
        "article_id", "title", "status", "kind", "sequence", "content")


@query("orphans", "SELECT l_partkey, l_suppkey, l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def orphans(spark, sf):
    li = I.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    o = I.table(spark, sf, "orders").where(F.col("o_orderstatus") != "P")
    return L.orphans(li, o, "l_orderkey", "o_orderkey")


@query("reconcile", """WITH c AS (SELECT (SELECT count(*) FROM documents) AS a, (SELECT count(*) FROM embeddings) AS v, (SELECT count(*) FROM labels) AS l)
SELECT 'articles_vs_vectors' AS check, a AS left_count, v AS right_count, CASE WHEN a = v THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c
UNION ALL SELECT 'vectors_cover_labels', v, l, CASE WHEN v >= l THEN 'PASS' ELSE 'FAIL' END FROM c
UNION ALL SELECT 'has_articles', a, 0, CASE WHEN a > 0 THEN 'PASS' ELSE 'FAIL' END FROM c""")
def reconcile(spark, sf):
    t = lambda n: I.table(spark, sf, n)
    return L.reconcile({"articles": t("documents"), "vectors": t("embeddings"), "labels": t("labels")},
                       [("articles_vs_vectors", "articles", "==", "vectors"), ("vectors_cover_labels", "vectors", ">=", "labels"),
                        ("has_articles", "articles", ">", "0")])


@query("article_stats", A + """ SELECT 'status' AS kind, status AS name, count(*) AS n FROM articles GROUP BY status
UNION ALL SELECT 'total', 'articles', count(*) FROM articles UNION ALL SELECT 'total', 'in_knowledge_base', count(*) FROM articles WHERE is_in_knowledge_base""")
def article_stats(spark, sf):
    return P.article_stats(I.articles(spark, sf))


@query("system_stats", A + "," + I.MESSAGES + "," + I.TASKS + """
SELECT count(*) AS total_articles, count(*) FILTER (status = 'parsed') AS parsed_articles, count(*) FILTER (is_in_knowledge_base) AS knowledge_base_articles,
 (SELECT count(DISTINCT session_id) FROM messages) AS chat_sessions, (SELECT count(*) FROM messages) AS chat_messages,
 (SELECT round(avg(parsing_duration_ms) / 1000, 1) FROM tasks WHERE status IN ('done', 'partial')) AS avg_parse_seconds FROM articles""")
def system_stats(spark, sf):
    m = I.messages(spark, sf)
    return P.system_stats(I.articles(spark, sf), m.select("session_id").distinct(), m, I.tasks(spark, sf))


@query("recent_operations", "SELECT event_id AS log_id, ts AS created_at, event_type AS action FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def recent_operations(spark, sf):
    return P.recent_operations(I.table(spark, sf, "events").select(
        F.col("event_id").alias("log_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("action")))


FEEDBACK = """feedback AS (SELECT event_id AS feedback_id, ts AS created_at, CASE WHEN event_type IN ('error', 'click') THEN 'not_helpful' ELSE 'helpful' END AS rating FROM events)"""


def _feedback(spark, sf):
    return I.table(spark, sf, "events").select(F.col("event_id").alias("feedback_id"), F.col("ts").alias("created_at"), F.when(
        F.col("event_type").isin("error", "click"), "not_helpful").otherwise("helpful").alias("rating"))


@query("feedback_stats", "WITH " + FEEDBACK + """
SELECT count(*) AS total, count(*) FILTER (rating = 'helpful') AS helpful, count(*) FILTER (rating <> 'helpful') AS not_helpful,
 round(count(*) FILTER (rating = 'helpful') / count(*) * 100, 1) AS rate FROM feedback""")
def feedback_stats(spark, sf):
    return P.feedback_stats(_feedback(spark, sf))


@query("recent_feedback", "WITH " + FEEDBACK + " SELECT * FROM feedback ORDER BY created_at DESC, feedback_id DESC LIMIT 10")
def recent_feedback(spark, sf):
    return P.recent_feedback(_feedback(spark, sf))


@query("state_distribution", "WITH " + I.TASKS + """
SELECT status, count(*) AS tasks, CASE WHEN status IN ('received', 'parsing') THEN count(*) ELSE 0 END AS stuck FROM tasks GROUP BY status""")
def state_distribution(spark, sf):
    return P.state_distribution(I.tasks(spark, sf))


FIELDS = ["task_uuid", "filename", "status", "parsing_duration_ms", "engine_selected"]


@query("field_completeness", "WITH " + I.TASKS + " " + " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) FILTER ({f} IS NULL) AS missing FROM tasks" for f in FIELDS))
def field_completeness(spark, sf):
    return P.field_completeness(I.tasks(spark, sf), FIELDS)


@query("monthly_trends", A + "," + I.MESSAGES + """, s AS (SELECT session_id, min(created_at) AS created_at FROM messages GROUP BY 1),
m AS (SELECT date_trunc('month', uploaded_at)::DATE AS month, status FROM articles), c AS (SELECT date_trunc('month', created_at)::DATE AS month FROM s),
b AS (SELECT min(month) AS lo, max(month) AS hi FROM (SELECT month FROM m UNION ALL SELECT month FROM c)),
cal AS (SELECT unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM b)
SELECT strftime(month, '%Y-%m') AS month, (SELECT count(*) FROM m WHERE m.month = cal.month) AS uploads,
 (SELECT count(*) FROM m WHERE m.month = cal.month AND status IN ('parsed', 'reviewing', 'approved')) AS parsed,
 (SELECT count(*) FROM m WHERE m.month = cal.month AND status = 'approved') AS approved, (SELECT count(*) FROM c WHERE c.month = cal.month) AS chats FROM cal""")
def monthly_trends(spark, sf):
    s = I.messages(spark, sf).groupBy("session_id").agg(F.min("created_at").alias("created_at"))
    return P.monthly_trends(I.articles(spark, sf), s)


@query("department_distribution", A + " SELECT department, count(*) AS articles FROM articles GROUP BY department")
def department_distribution(spark, sf):
    return P.department_distribution(I.articles(spark, sf))


@query("session_message_counts", "WITH " + I.MESSAGES + " SELECT session_id, count(*) AS messages, max(created_at) AS updated_at FROM messages GROUP BY session_id")
def session_message_counts(spark, sf):
    return P.session_message_counts(I.messages(spark, sf))


@query("session_history", "WITH " + I.MESSAGES + """
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY message_no) - 1 AS position, role, content FROM messages""")
def session_history(spark, sf):
    return P.session_history(I.messages(spark, sf)).select("session_id", "position", "role", "content")


@query("latency_report", """
WITH c AS (SELECT event_type AS method, '/api/' || (user_id % 5) AS path, floor(value * 100)::BIGINT AS duration_ms FROM events)
SELECT method, path, count(*) AS calls, min(duration_ms) AS min, round(median(duration_ms), 6) AS median, max(duration_ms) AS max FROM c GROUP BY method, path""")
def latency_report(spark, sf):
    e = I.table(spark, sf, "events")
    return P.latency_report(e.select(F.col("event_type").alias("method"), F.concat(F.lit("/api/"), (F.col("user_id") % 5).cast("string")).alias("path"),
                                     F.floor(F.col("value") * 100).cast("bigint").alias("duration_ms")), ["method", "path"])


@query("audit_tail", """SELECT event_id, type, rank FROM (
  SELECT event_id, event_type AS type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 50""")
def audit_tail(spark, sf):
    return P.tail_by_type(I.table(spark, sf, "events").select("event_id", F.col("event_type").alias("type"), "ts")).select("event_id", "type", "rank")


# ---- table rewrites -----------------------------------------------------------------------
CHANGES = """changes AS (SELECT l_orderkey AS article_id, arg_max(CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'N' THEN 'parsed' ELSE 'rejected' END, (l_shipdate, l_partkey)) AS status,
  max(l_shipdate) AS changed_at FROM lineitem GROUP BY 1)"""


def _changes(spark, sf):
    """The latest status per article from its order lines (ties on the day broken by part)."""
    li = I.table(spark, sf, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "approved").when(F.col("l_returnflag") == "N", "parsed").otherwise("rejected")
    last = li.groupBy(F.col("l_orderkey").alias("article_id")).agg(
        F.max_by(status, F.struct("l_shipdate", "l_partkey")).alias("status"), F.max("l_shipdate").alias("changed_at"))
    return last


@query("set_article_status", A + "," + CHANGES + """
SELECT a.article_id, coalesce(c.status, a.status) AS status, CASE WHEN c.status = 'parsed' THEN c.changed_at END AS parsed_at,
 CASE WHEN c.status = 'approved' THEN c.changed_at END AS approved_at, a.is_in_knowledge_base OR coalesce(c.status = 'approved', false) AS is_in_knowledge_base
FROM articles a LEFT JOIN changes c USING (article_id)""")
def set_article_status(spark, sf):
    return M.set_article_status(I.articles(spark, sf), _changes(spark, sf)).select(
        "article_id", "status", "parsed_at", "approved_at", "is_in_knowledge_base")


@query("update_tasks", "WITH " + I.TASKS + """
SELECT t.task_uuid, CASE WHEN e.event_type = 'click' THEN 'done' ELSE t.status END AS status,
 CASE WHEN e.event_type = 'click' THEN e.user_id ELSE t.parsing_duration_ms END AS parsing_duration_ms FROM tasks t JOIN events e ON e.event_id = t.event_id""")
def update_tasks(spark, sf):
    e = I.table(spark, sf, "events").where(F.col("event_type") == "click")
    changes = e.select(F.md5(F.col("event_id").cast("string")).alias("task_uuid"), F.lit("done").alias("status"),
                       F.col("user_id").alias("parsing_duration_ms"), F.col("ts").alias("updated_at"))
    return M.update_tasks(I.tasks(spark, sf), changes).select("task_uuid", "status", "parsing_duration_ms")


@query("cascade_delete", A + "," + S + """, gone AS (SELECT article_id FROM articles WHERE department = 'Other')
SELECT 'articles' AS tbl, article_id, 0::BIGINT AS sequence FROM articles WHERE article_id NOT IN (SELECT article_id FROM gone)
UNION ALL SELECT 'segments', article_id, sequence FROM segments WHERE article_id NOT IN (SELECT article_id FROM gone)""")
def cascade_delete(spark, sf):
    a = I.articles(spark, sf)
    left = M.cascade_delete(a.where(F.col("department") == "Other"), "article_id", articles=a, segments=I.segments(spark, sf))
    return left["articles"].select(F.lit("articles").alias("tbl"), "article_id", F.lit(0).cast("bigint").alias("sequence")).unionByName(
        left["segments"].select(F.lit("segments").alias("tbl"), "article_id", "sequence"))


@query("retry_tasks", "WITH " + I.TASKS + """, v AS (SELECT *, CASE WHEN status NOT IN ('failed', 'partial') THEN 'not_retryable' WHEN retry_count + 1 > max_retries THEN 'limit_reached' ELSE 're-enqueued' END AS verdict FROM tasks)
SELECT task_uuid, verdict, CASE WHEN verdict = 're-enqueued' THEN 'received' ELSE status END AS status, CASE WHEN verdict = 're-enqueued' THEN retry_count + 1 ELSE retry_count END AS retry_count,
 CASE WHEN verdict = 're-enqueued' THEN 'pending' ELSE 'failed' END AS faiss_status FROM v""")
def retry_tasks(spark, sf):
    return M.retry_tasks(I.tasks(spark, sf)).select("task_uuid", "verdict", "status", "retry_count", "faiss_status")


@query("recount_children", A + "," + S + " SELECT a.article_id, (SELECT count(*) FROM segments s WHERE s.article_id = a.article_id) AS segment_count FROM articles a")
def recount_children(spark, sf):
    a = I.articles(spark, sf).withColumn("segment_count", F.lit(0))
    return M.recount(a, I.segments(spark, sf), "article_id", "segment_count").select("article_id", "segment_count")


@query("rate_messages", "WITH " + I.MESSAGES + """, r AS (SELECT user_id % 100 * 1000 AS rated, arg_max(k, (ts, event_id)) AS rating, arg_max(event_type, (ts, event_id)) AS feedback FROM (
  SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1)
SELECT session_id * 1000 + message_no AS message_id, rating, feedback FROM messages LEFT JOIN r ON rated = session_id * 1000 + message_no""")
def rate_messages(spark, sf):
    m = I.messages(spark, sf).select((F.col("session_id") * 1000 + F.col("message_no")).alias("message_id"),
                                     F.lit(0).alias("rating"), F.lit("").alias("feedback"))
    e = I.table(spark, sf, "events")
    ratings = e.select((F.col("user_id") % 100 * 1000).alias("message_id"), F.get_json_object("props", "$.k").cast("bigint").alias("rating"),
                       F.col("event_type").alias("feedback"), F.struct("ts", "event_id").alias("rated_at"))
    return M.rate_messages(m, ratings)


@query("append_rows", """WITH m AS (SELECT max(o_orderkey) AS n FROM orders)
SELECT o_orderkey AS article_id, o_orderpriority AS title, 'approved' AS status FROM orders
UNION ALL SELECT n + row_number() OVER (ORDER BY doc_id), coalesce(source, ''), 'pending' FROM documents, m""")
def append_rows(spark, sf):
    base = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_orderpriority").alias("title"), F.lit("approved").alias("status"))
    fresh = I.text_table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"))
    return M.append_rows(base, fresh, "article_id", ["doc_id"], {"title": F.lit(""), "status": F.lit("pending")})

