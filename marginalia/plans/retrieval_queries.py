"""Queries over retrieval, lookup joins, evaluation and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import rules as R
from marginalia.operators import evaluate as V
from marginalia.operators import lookups as L
from marginalia.operators import retrieval as Q
from marginalia.plans import inputs as I
from marginalia.plans.registry import query
from marginalia.session import written

H = "WITH " + I.hits_sql(20)


def _hits(spark, sf):
    return I.hits(spark, sf, 20)


@query("topk_inner_product", "WITH " + I.CENTROIDS + """
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 5 AND score > 0.3""")
def topk_inner_product(spark, sf):
    return Q.topk_inner_product(I.centroid_queries(spark, sf), I.vectors(spark, sf), 5, 0.3)


@query("topk_large_batch", """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS score
  FROM embeddings a, embeddings b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def topk_large_batch(spark, sf):
    """Every vector asks, more at a time than are shipped to the tasks."""
    v = I.vectors(spark, sf)
    return Q.topk_inner_product(v.withColumnRenamed("vec_id", "query_id"), v, 5, None, max_rows=64)


TARGETS = """
routed_to AS (SELECT label::BIGINT AS query_id, CASE WHEN label IN (0, 3, 6, 9) THEN 'ALL' ELSE 'doc' || (vec_id % 10) END AS target FROM embeddings),
targets AS (SELECT DISTINCT query_id, target FROM routed_to WHERE target <> 'ALL')"""


def _targets(spark, sf):
    """What a router answered per topic: some documents, or ALL for no filter."""
    target = F.when(F.col("label").isin(0, 3, 6, 9), "ALL").otherwise(
        F.concat(F.lit("doc"), (F.col("vec_id") % 10).cast("string")))
    e = I.table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("query_id"), target.alias("target"))
    return e.where(F.col("target") != "ALL").distinct()


@query("filter_hits_by_doc", H + "," + TARGETS + """
SELECT query_id, vec_id FROM hits h WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE t.query_id = h.query_id) OR EXISTS (
  SELECT 1 FROM targets t WHERE t.query_id = h.query_id AND (contains(h.source, t.target) OR contains(t.target, h.source)))""")
def filter_hits_by_doc(spark, sf):
    return L.filter_hits_by_doc(_hits(spark, sf), _targets(spark, sf)).select("query_id", "vec_id")


@query("doc_aware_retrieve", H + "," + TARGETS + """,
f AS (SELECT h.query_id, vec_id, source, r.query_id IS NOT NULL AS routed, score, rank AS search FROM hits h
  LEFT JOIN (SELECT DISTINCT query_id FROM targets) r ON r.query_id = h.query_id
  WHERE score > 0.2 AND (r.query_id IS NULL OR EXISTS (SELECT 1 FROM targets t WHERE t.query_id = h.query_id
    AND (contains(h.source, t.target) OR contains(t.target, h.source))))),
b AS (SELECT query_id, vec_id, search, CASE WHEN routed THEN least(1.0, score * 1.3) ELSE score END AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY search) AS rank FROM b WHERE score > 0.3)
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def doc_aware_retrieve(spark, sf):
    return Q.doc_aware_retrieve(I.centroid_queries(spark, sf), I.vectors(spark, sf), I.passages(spark, sf),
                                _targets(spark, sf)).select("query_id", "vec_id", "rank", "score")


@query("hits_to_chunks", H + " SELECT query_id, vec_id, source, section_tag FROM hits")
def hits_to_chunks(spark, sf):
    found = Q.topk_inner_product(I.centroid_queries(spark, sf), I.vectors(spark, sf), 20, None)
    return L.hits_to_chunks(found, I.passages(spark, sf)).select("query_id", "vec_id", "source", "section_tag")


@query("dedup_hits", H + """ SELECT query_id, vec_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, left(text, 100) ORDER BY rank) AS rn FROM hits) WHERE rn = 1""")
def dedup_hits(spark, sf):
    return Q.dedup_hits(_hits(spark, sf)).select("query_id", "vec_id", "rank")


@query("rank_by_evidence", H + """
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY evidence_level, score DESC, vec_id) AS evidence_rank FROM hits""")
def rank_by_evidence(spark, sf):
    return Q.rank_by_evidence(_hits(spark, sf)).select("query_id", "vec_id", "evidence_rank")


@query("filter_by_section", H + """, n AS (SELECT *, count(*) FILTER (section_tag IN ('safety', 'results')) OVER (PARTITION BY query_id) AS n FROM hits)
SELECT query_id, vec_id, section_tag FROM n WHERE n < 2 OR section_tag IN ('safety', 'results')""")
def filter_by_section(spark, sf):
    return Q.filter_by_section(_hits(spark, sf), ["safety", "results"]).select("query_id", "vec_id", "section_tag")


LABEL_SQL = ("CASE evidence_level WHEN 1 THEN 'Meta分析/系统综述' WHEN 2 THEN 'RCT' WHEN 3 THEN '队列研究' WHEN 4 THEN '病例对照' "
             "WHEN 5 THEN '病例报告' WHEN 6 THEN '专家共识' ELSE '未知证据' END")


# some queries find nothing
ASKED = "asked AS (SELECT query_id FROM queries UNION ALL SELECT query_id + 1000 FROM queries WHERE query_id % 3 = 0)"


def _asked(spark, sf):
    q = I.table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("query_id")).distinct()
    return q.unionByName(q.where("query_id % 3 = 0").select((F.col("query_id") + 1000).alias("query_id")))


@query("assemble_context", H + f""", {ASKED}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY evidence_level, rank) AS i,
  count(*) OVER (PARTITION BY query_id) AS n FROM hits),
t AS (SELECT query_id, any_value(n) AS n, chr(10) || string_agg(chr(10) || '--- 结果 ' || i || ' ---' || chr(10) || '[' || {LABEL_SQL} ||
  '] 来源: ' || source || ', 章节: ' || section_tag || chr(10) || text, chr(10) ORDER BY i) FILTER (i <= 10) AS listed FROM o GROUP BY query_id)
SELECT query_id, coalesce(n, 0) AS hits, '## 检索上下文' || chr(10) || chr(10) || '查询: topic ' || query_id || chr(10) || chr(10) || chr(10) ||
  '### 检索结果 (共 ' || coalesce(n, 0) || ' 条)' || coalesce(listed, '') || chr(10) || chr(10) || chr(10) ||
  '## 回答要求' || chr(10) || '1. 请基于以上检索结果回答问题' || chr(10) || '2. 给出每个关键事实的来源引用（文献+页码+证据等级）' || chr(10) ||
  '3. 如有多个来源，说明证据是否一致' || chr(10) || '4. 如检索结果不充分，明确指出不确定之处' AS context FROM asked LEFT JOIN t USING (query_id)""")
def assemble_context(spark, sf):
    q = _asked(spark, sf).withColumn("text", F.concat(F.lit("topic "), F.col("query_id").cast("string")))
    return Q.assemble_context(_hits(spark, sf), q)


@query("blend_rerank", H + """, m AS (SELECT *, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE vec_id % 11 END AS ms, count(*) OVER (PARTITION BY query_id) AS n FROM hits),
b AS (SELECT *, CASE WHEN n > 5 AND rank <= 10 THEN score * 0.3 + coalesce(ms / 10.0, 0.5) * 0.7 ELSE score END AS final_score FROM m)
SELECT query_id, vec_id, round(final_score, 6) AS final_score,
  row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 5 THEN -final_score ELSE rank END, rank) AS final_rank FROM b""")
def blend_rerank(spark, sf):
    h = _hits(spark, sf)
    scores = h.select("query_id", "rank", F.when(F.col("vec_id") % 4 != 0, F.col("vec_id") % 11).alias("model_score"))
    return Q.blend_rerank(h, scores).select("query_id", "vec_id", "final_score", "final_rank")


@query("parent_page_context", H + "," + """pages2 AS (SELECT doc_name, page_idx, text FROM passages WHERE text <> '' AND type <> 'image')
SELECT DISTINCT query_id, h.doc_name, h.page_idx, left(p.text, 3000) AS full_text FROM hits h JOIN pages2 p ON p.doc_name = h.doc_name AND p.page_idx = h.page_idx""")
def parent_page_context(spark, sf):
    pages = I.passages(spark, sf).where(F.col("type") != "image").select("doc_name", "page_idx", "text")
    return L.parent_page_context(_hits(spark, sf), pages)


@query("match_files", """
WITH files AS (SELECT DISTINCT 'Customer#0000000' || (c_custkey % 500) || '.pdf' AS file_name FROM customer), stems AS (
SELECT file_name, replace(file_name, '.pdf', '') AS stem FROM files)
SELECT file_name, CASE WHEN EXISTS (SELECT 1 FROM customer WHERE contains(c_name, stem)) THEN 'indexed' ELSE 'uploaded' END AS status FROM stems""")
def match_files(spark, sf):
    c = I.table(spark, sf, "customer")
    files = c.select(F.concat(F.lit("Customer#0000000"), (F.col("c_custkey") % 500).cast("string"), F.lit(".pdf")).alias("file_name")).distinct()
    return L.match_files(files, c.select(F.col("c_name").alias("doc_name")))


@query("route_queries", """
WITH a AS (SELECT event_id AS query_id, ' ' || user_id || ' ; u' || (user_id + 1) || ';' || event_type AS answer FROM events),
n AS (SELECT DISTINCT query_id, trim(unnest(string_split(answer, ';'))) AS target FROM a)
SELECT query_id, target FROM n WHERE target IN (SELECT c_custkey::VARCHAR FROM customer UNION SELECT 'u' || s_suppkey FROM supplier)""")
def route_queries(spark, sf):
    u = F.col("user_id")
    a = I.table(spark, sf, "events").select(F.col("event_id").alias("query_id"), F.concat(
        F.lit(" "), u.cast("string"), F.lit(" ; u"), (u + 1).cast("string"), F.lit(";"), F.col("event_type")).alias("answer"))
    docs = I.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("doc_name")).unionByName(
        I.table(spark, sf, "supplier").select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("doc_name")))
    return L.route_queries(a, docs)


@query("cross_check", H + f""", l AS (SELECT *, {I.sql_rules('text', R.EVIDENCE_LABEL_RULES, None)} AS label, doc_name AS d FROM hits),
g AS (SELECT query_id, d AS doc_name, coalesce(arg_min(label, rank) FILTER (label IS NOT NULL), 'unknown') AS evidence, min(rank) AS first_rank,
  array_to_string(list(left(text, 300) ORDER BY rank)[1:2], '|') AS findings FROM l GROUP BY query_id, d),
n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS documents FROM g)
SELECT *, CASE WHEN documents < 2 THEN 'insufficient' ELSE 'compared' END AS assessment FROM n""")
def cross_check(spark, sf):
    return Q.cross_check(_hits(spark, sf))


@query("cross_check_levels", H + f""", l AS (SELECT query_id, doc_name, rank, coalesce({I.sql_rules('text', R.EVIDENCE_LABEL_RULES, None)}, 'unknown') AS evidence FROM hits)
SELECT query_id, evidence, count(*) AS documents, array_to_string(list(doc_name ORDER BY rank), '|') AS names FROM l GROUP BY 1, 2""")
def cross_check_levels(spark, sf):
    return Q.cross_check_levels(Q.cross_check(_hits(spark, sf)))


ERRORS = I.pick("query_id", ["Connection reset", "request timeout", "auth failed", "HTTP 403", "rate limited", "HTTP 429", "boom"])


@query("extractive_answer", H + f""", {ASKED}, e AS (SELECT query_id, {ERRORS} AS error FROM asked),
t AS (SELECT query_id, string_agg('**来源 ' || rank || '**: ' || source || chr(10) || '> ' || left(text, 400) || chr(10), chr(10) ORDER BY rank) AS quoted
  FROM hits WHERE rank <= 5 GROUP BY query_id)
SELECT query_id, CASE WHEN quoted IS NULL THEN '抱歉，当前无法处理您的请求。Agent推理引擎和FAISS检索均不可用。' || chr(10) || '错误: ' || error ELSE
 '## 检索结果 (FAISS 直接检索，未经过 LLM 推理)' || chr(10) || chr(10) || quoted || chr(10) ||
 CASE error WHEN 'Connection reset' THEN '{Q.FALLBACK_CONNECTION}' WHEN 'request timeout' THEN '{Q.FALLBACK_CONNECTION}'
 WHEN 'auth failed' THEN '{Q.FALLBACK_AUTH}' WHEN 'HTTP 403' THEN '{Q.FALLBACK_AUTH}' WHEN 'rate limited' THEN '{Q.FALLBACK_RATE}'
 WHEN 'HTTP 429' THEN '{Q.FALLBACK_RATE}' ELSE '{Q.FALLBACK_OTHER}boom' END || chr(10) || '{Q.FALLBACK_TAIL}' END AS answer
FROM e LEFT JOIN t USING (query_id)""")
def extractive_answer(spark, sf):
    return Q.extractive_answer(_hits(spark, sf), _asked(spark, sf).withColumn("error", F.expr(ERRORS)))


@query("numbered_sources", H + """ SELECT query_id, rank AS ref, source, round(score, 3) AS score, left(text, 200) AS text_preview, image_url,
  CASE WHEN image_url IS NOT NULL THEN type END AS chart_type FROM hits""")
def numbered_sources(spark, sf):
    return Q.numbered_sources(_hits(spark, sf))


@query("search_result_set", H + """, g AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN left(repeat('graph ' || query_id || ' ', 90), 600) END AS graph_context FROM queries)
SELECT query_id, count(*) AS source_count, any_value(graph_context) AS graph_context, CASE WHEN any_value(graph_context) IS NULL THEN 'faiss' ELSE 'hybrid' END AS engine,
 string_agg(rank || ':' || source || ':' || left(text, 500) || ':' || doc_name || ':' || page_idx || ':' || section_tag, '|' ORDER BY rank) AS snippets
FROM hits LEFT JOIN g USING (query_id) GROUP BY query_id""")
def search_result_set(spark, sf):
    q = I.table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("query_id")).distinct()
    text = F.repeat(F.concat(F.lit("graph "), F.col("query_id").cast("string"), F.lit(" ")), F.lit(200))
    g = q.withColumn("summary", F.when(F.col("query_id") % 2 == 0, text))
    r = Q.search_result_set(q, _hits(spark, sf), g)
    line = lambda s: F.concat_ws(":", s["ref"].cast("string"), s["source"], s["text"], s["doc"], s["page_idx"].cast("string"), s["section"])
    return r.withColumn("snippets", F.transform("snippets", line))


# an agent run is a conversation; a turn's text becomes the preview of its tool call
TRACE_TOOL = I.pick("turn", ["search_rag", "self_reflect", "list_docs"])


@query("trace_sources", f"""
WITH t AS (SELECT conv_id AS run_id, turn AS step, {TRACE_TOOL} AS tool, text, role FROM conversations),
i AS (SELECT run_id, step, 0 AS pos, text AS title, '/i.png' AS image_url, left(text, 200) AS text_preview FROM t WHERE tool <> 'list_docs'
 UNION ALL SELECT run_id, step, 1, role, NULL, NULL FROM t WHERE tool <> 'list_docs'),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC, pos) AS rank FROM i)
SELECT run_id, rank, title, '文献' AS type, image_url, text_preview FROM r WHERE rank <= 8""")
def trace_sources(spark, sf):
    c = I.table(spark, sf, "conversations")
    items = F.array(F.struct(F.col("text").alias("source"), F.lit("/i.png").alias("image_url"), F.lit("image").alias("type"), F.col("text").alias("text")),
                    F.struct(F.col("role").alias("source"), F.lit(None).cast("string").alias("image_url"), F.lit("t").alias("type"), F.lit("x").alias("text")))
    preview = F.when(F.col("turn") % 2 == 0, F.to_json(items)).otherwise(F.to_json(F.struct(items.alias("文献证据"))))
    return Q.trace_sources(c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("step"), F.expr(TRACE_TOOL).alias("tool"),
                                    F.concat(preview, F.lit("...")).alias("result_preview")))


@query("conversation_context", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
SELECT conv_id, max(turn) AS current_turn, string_agg(CASE WHEN rn = 1 THEN text ELSE text || '|' || left(role || ' ' || text, 500) END, '|' ORDER BY turn) AS messages
FROM r WHERE rn <= 4 GROUP BY conv_id""")
def conversation_context(spark, sf):
    c = I.table(spark, sf, "conversations")
    return Q.conversation_context(c.select("conv_id", "turn", F.col("text").alias("question"), F.concat_ws(" ", "role", "text").alias("answer")))


@query("expand_query_terms", """
WITH q AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '高血压 ' WHEN 1 THEN '卒中 心肌梗死 ' ELSE '' END || text AS t FROM conversations)
SELECT conv_id || '-' || turn AS query_id, t AS search_text FROM q
UNION ALL SELECT conv_id || '-' || turn, unnest(['hypertension', 'antihypertensive', 'blood pressure management']) FROM q WHERE turn % 3 = 0
UNION ALL SELECT conv_id || '-' || turn, unnest(['myocardial infarction', 'MI', 'STEMI', 'NSTEMI', 'stroke', 'cerebrovascular', 'CVA', 'TIA']) FROM q WHERE turn % 3 = 1""")
def expand_query_terms(spark, sf):
    c = I.table(spark, sf, "conversations")
    head = F.expr(I.pick("turn", ["高血压 ", "卒中 心肌梗死 ", ""]))
    return L.expand_query_terms(c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
                                         F.concat(head, F.col("text")).alias("text")), L.MESH_SYNONYMS)


# ---- text queries: benchmark items searched with the hashing encoder ----------------------
DIM = 64
BENCH = f"""
qtok AS (SELECT item_id AS query_id, unnest({I.sql_words('text')}) AS w FROM benchmark),
qvec AS (SELECT query_id, ('0x' || left(md5(w), 6))::BIGINT % {DIM} AS b, count(*)::DOUBLE AS c FROM qtok GROUP BY 1, 2),
qn AS (SELECT query_id, sqrt(sum(c * c)) AS n FROM qvec GROUP BY 1),
ptok AS (SELECT vec_id, unnest({I.sql_words('text')}) AS w FROM passages),
pvec AS (SELECT vec_id, ('0x' || left(md5(w), 6))::BIGINT % {DIM} AS b, count(*)::DOUBLE AS c FROM ptok GROUP BY 1, 2),
pn AS (SELECT vec_id, sqrt(sum(c * c)) AS n FROM pvec GROUP BY 1),
dot AS (SELECT query_id, vec_id, sum((q.c / qn.n) * (p.c / pn.n)) AS s FROM qvec q JOIN pvec p USING (b) JOIN qn USING (query_id) JOIN pn USING (vec_id) GROUP BY 1, 2),
tranked AS (SELECT query_id, vec_id, round(s, 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM dot),
thits AS (SELECT t.*, text, type, source, doc_name, page_idx FROM tranked t JOIN passages USING (vec_id) WHERE rank <= 10 AND score > 0.3),
cases AS (SELECT item_id AS query_id, 'cat' || (item_id % 5) AS category,
  list_sort(list_distinct(list_filter({I.sql_words('text')}, lambda w: length(w) >= 6)))[1:6] AS keywords FROM benchmark)"""
T = "WITH " + I.PASSAGES + "," + BENCH


def encode(df, text):
    return Q.batch_embed(df, text, dim=DIM).select("query_id", "embedding")


def passage_vectors(spark, sf):
    return Q.batch_embed(I.passages(spark, sf).select("vec_id", "text"), "text", dim=DIM).select("vec_id", "embedding")


def stored_vectors(spark, sf):
    """The vectors of all passages embedded once and stored, for what searches them more than once."""
    return written(passage_vectors(spark, sf))


def cases(spark, sf):
    from marginalia.functions.text import words
    b = I.table(spark, sf, "benchmark")
    kw = F.slice(F.array_sort(F.array_distinct(F.filter(words("text"), lambda w: F.length(w) >= 6))), 1, 6)
    return b.select(F.col("item_id").alias("query_id"), "text", F.concat(F.lit("cat"), (F.col("item_id") % 5).cast("string")).alias("category"), kw.alias("keywords"))


def text_hits(spark, sf):
    q = encode(cases(spark, sf).select("query_id", "text"), "text")
    return Q.topk_inner_product(q, passage_vectors(spark, sf), 10, 0.3).join(I.passages(spark, sf), "vec_id")


@query("batch_embed", "WITH " + I.PASSAGES + f""", tok AS (SELECT vec_id, unnest({I.sql_words('text')}) AS w FROM passages),
v AS (SELECT vec_id, ('0x' || left(md5(w), 6))::BIGINT % {DIM} AS b, count(*)::DOUBLE AS c FROM tok GROUP BY 1, 2)
SELECT vec_id, b AS bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY vec_id)), 6) AS value FROM v""")
def batch_embed(spark, sf):
    return passage_vectors(spark, sf).select("vec_id", F.posexplode("embedding").alias("bucket", "value")).where(F.col("value") != 0)


@query("text_search", T + " SELECT query_id, vec_id, rank, round(score, 6) AS score FROM thits")
def text_search(spark, sf):
    return text_hits(spark, sf).select("query_id", "vec_id", "rank", "score")


METRICS = T + """, g AS (SELECT query_id, string_agg(lower(text), ' ' ORDER BY rank) AS t10, string_agg(left(lower(text), 500), ' ' ORDER BY rank) FILTER (rank <= 5) AS t5 FROM thits GROUP BY 1),
kw AS (SELECT query_id, unnest(keywords) AS k FROM cases),
rel AS (SELECT h.query_id, h.rank, bool_or(contains(lower(h.text), k)) AS ok FROM thits h JOIN kw USING (query_id) GROUP BY 1, 2),
a AS (SELECT c.query_id, any_value(category) AS category, count(k) AS keywords, coalesce(sum(contains(t10, k)::INT), 0)::BIGINT AS keyword_hits,
  coalesce(sum(contains(t5, k)::INT), 0) AS h5 FROM cases c LEFT JOIN kw USING (query_id) LEFT JOIN g USING (query_id) GROUP BY 1),
metrics AS (SELECT a.query_id, category, keywords, keyword_hits, keyword_hits / greatest(1, keywords) AS keyword_hit_rate, h5 / greatest(1, keywords) AS recall_at_5,
  (SELECT count(*) FROM rel r WHERE r.query_id = a.query_id AND rank <= 5 AND ok) / greatest(1, (SELECT count(*) FROM thits r WHERE r.query_id = a.query_id AND rank <= 5)) AS precision_at_5,
  coalesce(1.0::DOUBLE / (SELECT min(rank) FROM rel r WHERE r.query_id = a.query_id AND ok), 0) AS reciprocal_rank,
  EXISTS (SELECT 1 FROM thits r WHERE r.query_id = a.query_id) AS has_source FROM a)"""


def metrics(spark, sf):
    return V.retrieval_metrics(cases(spark, sf), text_hits(spark, sf))


@query("retrieval_metrics", METRICS + """ SELECT query_id, category, keywords, keyword_hits, round(keyword_hit_rate, 6) AS keyword_hit_rate,
 round(recall_at_5, 6) AS recall_at_5, round(precision_at_5, 6) AS precision_at_5, round(reciprocal_rank, 6) AS reciprocal_rank, has_source FROM metrics""")
def retrieval_metrics(spark, sf):
    return metrics(spark, sf)


@query("retrieval_report", METRICS + """ SELECT category, count(*) AS queries, count(*) FILTER (keyword_hit_rate >= 0.5) AS successful,
 round(avg(keyword_hit_rate), 6) AS keyword_hit_rate, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(precision_at_5), 6) AS precision_at_5,
 round(avg(reciprocal_rank), 6) AS mrr FROM metrics GROUP BY ROLLUP (category)""")
def retrieval_report(spark, sf):
    return V.retrieval_report(metrics(spark, sf))


@query("quick_recall", T + """, g AS (SELECT query_id, string_agg(left(text, 300), ' ' ORDER BY rank) AS t, count(*) AS n FROM thits WHERE rank <= 5 GROUP BY 1)
SELECT query_id, len(list_filter(keywords, lambda k: contains(coalesce(t, ''), k))) AS keyword_hits, len(keywords) AS keywords_expected,
 round(len(list_filter(keywords, lambda k: contains(coalesce(t, ''), k))) / greatest(1, len(keywords)), 6) AS recall, coalesce(n, 0) AS sources
FROM cases LEFT JOIN g USING (query_id)""")
def quick_recall(spark, sf):
    return V.quick_recall(cases(spark, sf), text_hits(spark, sf))


def sql_text_query(name: str, query_rows: str, k: int) -> str:
    """Search with given (query_id, text) rows through the hashing encoder."""
    bench = BENCH.split("ptok AS")[0].replace("FROM benchmark", f"FROM {name}").replace("item_id AS query_id", "query_id")
    rest = "ptok AS" + BENCH.split("ptok AS")[1].split("cases AS")[0].rstrip().rstrip(",").replace("rank <= 10", f"rank <= {k}")
    return "WITH " + I.PASSAGES + f", {name} AS ({query_rows})," + bench + rest


@query("deep_retrieve", sql_text_query("asked", """SELECT md5(topic || ' ' || aspect) AS query_id, topic || ' ' || aspect AS text, topic, aspect FROM (
  SELECT text AS topic, unnest(['heon than', 'nder with', 'le la de']) AS aspect FROM (SELECT DISTINCT text FROM benchmark))""", 3) + """
SELECT topic, aspect, rank, source, left(h.text, 300) AS text FROM thits h JOIN asked USING (query_id)""")
def deep_retrieve(spark, sf):
    topics = I.table(spark, sf, "benchmark").select(F.col("text").alias("topic")).distinct().withColumn(
        "aspects", F.array(F.lit("heon than"), F.lit("nder with"), F.lit("le la de")))
    return Q.deep_retrieve(topics, encode, passage_vectors(spark, sf), I.passages(spark, sf))


@query("chart_hits", sql_text_query("asked", "SELECT item_id AS query_id, 'doc' || item_id || ' ' || text || ' 表格 图表' AS text FROM benchmark", 5) + """
SELECT query_id, rank, source, left(text, 500) AS text FROM thits""")
def chart_hits(spark, sf):
    r = I.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("doc"), F.col("item_id").cast("string")).alias("doc_name"),
                                              F.col("text").alias("hint"))
    return Q.chart_hits(r, encode, passage_vectors(spark, sf), I.passages(spark, sf))


@query("compare_tables", T + """, n AS (SELECT *, regexp_extract_all(text, '(\\d+\\.?\\d*)\\s*[%％]', 1)[1:5] AS nums FROM thits WHERE rank <= 5)
SELECT query_id AS doc, count(*) FILTER (type = 'table') AS tables_found,
 coalesce(array_to_string(list(left(text, 500) ORDER BY rank) FILTER (type = 'table')[1:3], '|'), '') AS tables,
 array_to_string(flatten(list(nums ORDER BY rank))[1:10], '|') AS numeric_samples FROM n GROUP BY query_id""")
def compare_tables(spark, sf):
    from marginalia.operators.evidence import compare_tables as compare
    h = text_hits(spark, sf).withColumnRenamed("query_id", "doc")
    return compare(h, cases(spark, sf).select(F.col("query_id").alias("doc")))


# ---- weak answers are searched again ------------------------------------------------------
QUESTION = "(" + I.pick("item_id", I.SENTENCES) + " || text)"
SAID = "(CASE item_id % 4 WHEN 0 THEN '[1] 来源 ' || text || text || text WHEN 1 THEN text || ' tool_call' WHEN 2 THEN text ELSE '来源 ' || text || text || text END)"
STEPS_TAKEN = "(item_id % 5)"
STEP_TOOL = I.pick("item_id", ["search_rag", "deep_retrieve", "search_rag", "list_docs"])
STEP_FOUND = "(CASE WHEN item_id % 7 = 0 THEN '未找到' ELSE 'ok' END)"
ROUTED = "(CASE WHEN item_id % 6 = 0 THEN 'doc' || (item_id % 10) END)"
_REFINED = f"array_to_string(list_filter(string_split_regex(replace(replace({QUESTION}, '？', ''), '?', ''), '\\s+'), lambda w: w <> '')[1:5], ' ')"
SECOND_SEARCH = sql_text_query("asked", f"""SELECT 'a' || item_id AS query_id, {QUESTION} AS text FROM benchmark UNION ALL
  SELECT 'b' || item_id, {_REFINED} FROM benchmark WHERE ({STEPS_TAKEN} = 0 OR {STEP_TOOL} = 'list_docs' OR {STEP_FOUND} = '未找到'
    OR contains({SAID}, '<｜') OR contains({SAID}, 'tool_call')) AND {_REFINED} <> ''""", 20).replace("score > 0.3", "score > 0.2") + f""",
aims AS (SELECT item_id::VARCHAR AS id, {ROUTED} AS target FROM benchmark WHERE {ROUTED} IS NOT NULL),
kept AS (SELECT substring(query_id, 2) AS id, CASE left(query_id, 1) WHEN 'a' THEN 1 ELSE 2 END AS search, vec_id, rank AS place,
  CASE WHEN target IS NULL THEN score ELSE least(1.0, score * 1.3) END AS score
  FROM thits LEFT JOIN aims ON id = substring(query_id, 2) WHERE target IS NULL OR contains(source, target) OR contains(target, source)),
per AS (SELECT *, row_number() OVER (PARTITION BY id, search ORDER BY place) AS no FROM kept WHERE score > 0.3),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, vec_id ORDER BY score DESC, search) AS i FROM per
  WHERE no <= CASE search WHEN 1 THEN 10 ELSE 8 END) WHERE i = 1),
merged AS (SELECT id::BIGINT AS query_id, vec_id, search, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, search, no, vec_id) AS rank FROM best)"""


@query("search_again", SECOND_SEARCH + " SELECT query_id, vec_id, search::BIGINT AS search, round(score, 6) AS score, rank FROM merged WHERE rank <= 10")
def search_again(spark, sf):
    b = I.table(spark, sf, "benchmark")
    step = F.struct(F.expr(STEP_TOOL).alias("tool"), F.expr(STEP_FOUND).alias("result_preview"))
    answers = b.select(F.col("item_id").alias("query_id"), F.expr(SAID).alias("answer"), F.array_repeat(step, F.expr(STEPS_TAKEN).cast("int")).alias("steps"))
    targets = b.select(F.col("item_id").alias("query_id"), F.expr(ROUTED).alias("target")).where("target IS NOT NULL")
    hits, _ = Q.search_again(b.select(F.col("item_id").alias("query_id"), F.expr(QUESTION).alias("text")), answers, encode, stored_vectors(spark, sf),
                             I.passage_rows(spark, sf).select("vec_id", "source"), targets)
    return hits.select("query_id", "vec_id", "search", "score", "rank")
