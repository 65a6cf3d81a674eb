"""Knowledge-base inputs derived from the given tables, for Spark and as SQL text.

The tables hold invented prose without medical words, so each line, passage and study gets a
medical sentence chosen by its position: rules then have something to find, every row of a
table takes part, and the work grows with the tables. The sentence and mapping expressions are
portable SQL shared by both sides; operators are written once in Spark and once in SQL.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import rules, text as T
from marginalia.functions.grading import EFFECT_TYPE

SENTENCES = [
    "Background and introduction to the disease. ",
    "Methods: randomized controlled trial, study design and sample size. ",
    "Primary endpoint was mortality at 30 days: HR = 0.75 (0.60-0.92). ",
    "Secondary outcome improved, 12.5% versus 18% (n=84). ",
    "Adverse events and bleeding complications were rare: 3% and 4.5 %. ",
    "Results: significant benefit, effective and superior, reduced shock. ",
    "Subgroup analysis: no significant change, no difference, not effective; small sample. ",
    "Prospective cohort study, adjusted by propensity score; OR=2.4(1.1–5.2). ",
    "结论: 治疗 有效 显著 改善 结果. ",
    "Meta-analysis and systematic review with heterogeneity, i2=45. ",
    "Discussion: limitation of this case report; findings may suggest an open-label pilot. ",
    "Statistical analysis used the baseline characteristics in table 1. ",
    "Figure 2 shows the survival curve; 0.42 (0.10-0.90) for hr. ",
    "Expert consensus guideline on LVAD, IABP and PCI; dose-response gradient. ",
    "Inclusion criteria and eligibility; 纳入 120 patients, unknown dropout. ",
    "",
]


def pick(expr: str, values: list[str]) -> str:
    """Portable SQL: the value at ``expr`` modulo the number of values."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE ({expr}) % {len(values)} {whens} END)"


LINE_SENTENCE = pick("doc_id + CAST(FLOOR(line_no / 3) AS BIGINT)", SENTENCES)
LINE_KIND = ("(CASE WHEN (doc_id + line_no) % 11 = 4 THEN 'image' WHEN (doc_id + line_no) % 11 = 8 "
             "THEN 'table' ELSE 'text' END)")
PAGE_OF_LINE = "CAST(FLOOR(line_no / 5) AS BIGINT)"
DOC_SENTENCE = pick("doc_id", SENTENCES)
DOC_SENTENCE_2 = pick("doc_id + 5", SENTENCES)
STUDY_TYPES = ["rct", "Meta-analysis", "meta_analysis", "cohort", "case-control", "systematic_review",
               "case report", "unknown", "randomized-controlled-trial"]
STUDY_TYPE = pick("doc_id", STUDY_TYPES)
EFFECT_VALUE = "(CAST(1 + n_chars % 60 AS DOUBLE) / 10)"
CHUNK_KIND = pick("doc_id", ["text", "table", "text", "image", "text"])

WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(12288))"


def sql_strip(x: str) -> str:
    return f"trim({x}, {WS})"


def sql_rules(text: str, rule_set: rules.Rules, default: str | None, prefix: int | None = None,
              fold: bool = True) -> str:
    """CASE over plain substring tests."""
    low = f"lower(left({text}, {prefix}))" if prefix else f"lower({text})"
    quote = lambda k: (k.lower() if fold else k).replace("'", "''")
    whens = " ".join("WHEN " + " OR ".join(f"contains({low}, '{quote(k)}')" for k in keys) + f" THEN '{label}'"
                     for label, keys in rule_set)
    return f"(CASE {whens} ELSE {'NULL' if default is None else repr(default)} END)"


def sql_count(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::BIGINT" for w in words) + ")"


def sql_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> '')"


def sql_noise(x: str) -> str:
    return (f"(length(regexp_replace({x}, '[A-Za-z0-9 .,;:!?()\\-\\[\\]{{}}%/=<>]|[^\\x00-\\x7F]', '', 'g'))"
            f" / length({x}))")


def sql_loop(x: str) -> str:
    w = sql_words(x)
    top = f"list_max(map_values(list_aggregate({w}, 'histogram')))"
    return f"coalesce(len({w}) >= 30 AND {top} > 30 AND {top} / len({w}) > 0.3, false)"


# ---- tables -------------------------------------------------------------------------------

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table with long texts, spread over the cores when it has fewer file splits than those.

    Text work is far heavier than moving a table this small; a table of many splits, the normal
    case at scale, is left as it is and not shuffled.
    """
    df = table(spark, sf, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread(df: DataFrame) -> DataFrame:
    """Small rows dealt evenly over four tasks a core, for work far heavier than moving them.

    File splits follow bytes and row groups: a table of short rows has few, whatever is made of a row.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    d = text_table(spark, sf, "documents")
    return d.select("doc_id", "lang", "source", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_name"),
                    F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("bigint"))


LINES = """
lines AS (
  SELECT doc_id, lang, source, 'doc' || doc_id AS doc_name,
         unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    """One content item per line; a page is five lines; some lines are images or tables."""
    b = lines(spark, sf)
    kind = F.expr(LINE_KIND)
    b = b.withColumn("kind", kind)
    return b.select(
        "doc_id", "doc_name", F.col("line_no").alias("item_idx"), F.col("kind").alias("type"),
        F.expr(PAGE_OF_LINE).alias("page_idx"),
        F.concat(F.expr(LINE_SENTENCE), F.col("line")).alias("text"),
        F.when(F.col("kind") == "image", F.when(F.col("line_no") % 2 == 0, F.array("line"))).alias("image_caption"),
        F.when(F.col("kind") == "table", F.array("source", "lang")).alias("table_caption"),
        F.when(F.col("kind") == "table", F.when(
            F.col("line_no") % 3 != 0, F.concat(F.lit("<table><tr><td>"), F.col("line"), F.lit("</td></tr></table>")))
            .otherwise("")).alias("table_body"),
        F.when(F.col("kind") == "image", F.concat(F.lit("/data/img/"), F.col("doc_name"), F.lit("_"),
                                                  F.col("line_no").cast("string"), F.lit(".png"))).alias("img_path"))


ITEMS = LINES + f""",
items AS (
  SELECT doc_id, doc_name, line_no AS item_idx, {LINE_KIND} AS type, {PAGE_OF_LINE} AS page_idx,
         {LINE_SENTENCE} || line AS text,
         CASE WHEN {LINE_KIND} = 'image' AND line_no % 2 = 0 THEN line
              WHEN {LINE_KIND} = 'table' THEN source || ' ' || lang ELSE '' END AS cap,
         CASE WHEN {LINE_KIND} = 'table' AND line_no % 3 <> 0
              THEN '<table><tr><td>' || line || '</td></tr></table>' ELSE '' END AS table_body
  FROM lines)"""

CHUNKS = ITEMS + f""",
candidates AS (
  SELECT doc_name, item_idx AS chunk_idx, type, page_idx,
         CASE WHEN type = 'text' AND length({sql_strip('text')}) > 30 THEN {sql_strip('text')}
              WHEN type = 'image' AND length(cap) > 10 THEN '[图片] ' || cap
              WHEN type = 'table' AND {sql_strip('table_body')} <> '' AND
                   length('[表格] ' || cap || chr(10) || table_body) > 30
              THEN '[表格] ' || cap || chr(10) || table_body END AS text
  FROM items),
hashed AS (
  SELECT *, md5(text) AS content_md5,
         doc_name || ' [p.' || page_idx || CASE WHEN type IN ('image', 'table') THEN ', ' || type ELSE '' END || ']' AS source
  FROM candidates WHERE text IS NOT NULL),
gated AS (
  SELECT * FROM hashed WHERE length(text) >= 30 AND {sql_noise('text')} <= 0.5 AND NOT {sql_loop('text')}),
chunks AS (
  SELECT * EXCLUDE (rn), CASE WHEN type = 'text' THEN
         {sql_rules('text', rules.SECTION_RULES, 'unknown', 300)} END AS section_tag
  FROM (SELECT *, row_number() OVER (PARTITION BY content_md5 ORDER BY doc_name, chunk_idx) AS rn FROM gated)
  WHERE rn = 1)"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    from marginalia.operators.ingest import build_chunks
    return build_chunks(items(spark, sf))


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Text items of a page joined by blank lines."""
    from marginalia.operators.chunking import merge_text_by_page
    return merge_text_by_page(items(spark, sf))


PAGES = ITEMS + """,
page_texts AS (
  SELECT doc_name, page_idx, string_agg(text, chr(10) || chr(10) ORDER BY item_idx) AS text
  FROM items WHERE type = 'text' GROUP BY doc_name, page_idx)"""


def passage_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as retrievable passages; ``vec_id = doc_id`` links them to vectors."""
    d = text_table(spark, sf, "documents")
    text = F.concat(F.expr(DOC_SENTENCE), F.col("text"))
    kind = F.expr(CHUNK_KIND)
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    page = F.col("doc_id") % 7
    return d.select(F.col("doc_id").alias("vec_id"), name.alias("doc_name"), page.alias("page_idx"), kind.alias("type"),
                 T.format_source(name, page, kind).alias("source"), text.alias("text"),
                 F.when(kind == "image", F.concat(F.lit("/images/"), name, F.lit(".png"))).alias("image_url"))


def labelled(p: DataFrame) -> DataFrame:
    """Section tag and evidence level of passages."""
    e = rules.detect_evidence_type("text")
    return p.withColumn("section_tag", rules.classify_section("text")).withColumn("evidence_level", e["level"])


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(passage_rows(spark, sf))


PASSAGES = f"""
passages AS (
  SELECT *, {sql_rules('text', rules.SECTION_RULES, 'unknown', 300)} AS section_tag,
         CASE {sql_rules('text', rules.EVIDENCE_TYPE_RULES, 'unknown', 2000)}
              WHEN 'meta_analysis' THEN 1 WHEN 'rct' THEN 2 WHEN 'cohort_study' THEN 3 WHEN 'case_control' THEN 4
              WHEN 'case_report' THEN 5 WHEN 'expert_consensus' THEN 6 ELSE 7 END AS evidence_level
  FROM (SELECT doc_id AS vec_id, 'doc' || doc_id AS doc_name, doc_id % 7 AS page_idx, {CHUNK_KIND} AS type,
               'doc' || doc_id || ' [p.' || (doc_id % 7) || CASE {CHUNK_KIND} WHEN 'text' THEN '' ELSE ', ' || {CHUNK_KIND} END
               || ']' AS source,
               {DOC_SENTENCE} || text AS text,
               CASE WHEN {CHUNK_KIND} = 'image' THEN '/images/doc' || doc_id || '.png' END AS image_url
        FROM documents))"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


def centroid_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One query per label: the normalised mean of its vectors."""
    e = table(spark, sf, "embeddings")
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    q = e.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(vector_to_array(mean).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x))
    return q.select("query_id", F.transform("c", lambda x: x / norm).alias("embedding"))


CENTROIDS = """
dims AS (
  SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
means AS (SELECT label, pos, avg(v) AS m FROM dims GROUP BY label, pos),
raw_queries AS (SELECT label::BIGINT AS query_id, list(m ORDER BY pos) AS c FROM means GROUP BY label),
queries AS (
  SELECT query_id, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS q FROM raw_queries),
scored AS (
  SELECT query_id, vec_id, round(list_inner_product(q, embedding::DOUBLE[]), 12) AS score
  FROM queries, embeddings),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)"""


def hits(spark: SparkSession, sf: str, k: int = 20, min_score: float | None = None) -> DataFrame:
    """Passages found for the label queries."""
    from marginalia.operators.retrieval import topk_inner_product
    found = topk_inner_product(centroid_queries(spark, sf), vectors(spark, sf), k, min_score)
    # labels are computed on the hits, not on the corpus
    return labelled(found.join(passage_rows(spark, sf), "vec_id"))


def hits_sql(k: int = 20) -> str:
    return CENTROIDS + "," + PASSAGES + f""",
hits AS (SELECT * FROM ranked JOIN passages USING (vec_id) WHERE rank <= {k})"""


def studies(spark: SparkSession, sf: str) -> DataFrame:
    """Gradable studies: design, findings, PICO parts and effect sizes per document."""
    d = text_table(spark, sf, "documents")
    v = F.expr(EFFECT_VALUE)

    def effect(value, lo, hi):
        return F.struct(value.alias("effect_value"), lo.alias("ci_lower"), hi.alias("ci_upper"), F.lit("HR").alias("effect_measure"))

    effects = F.when(F.col("doc_id") % 4 == 3, F.array().cast(EFFECT_TYPE)).otherwise(F.array(
        effect(v, v * 0.5, v * (1 + F.col("doc_id") % 7)), effect(v + 0.7, v * 0.25, v * 2)))
    part = lambda k: F.when(F.col("doc_id") % k == 0, "").otherwise(F.col("lang"))
    return d.select(
        "doc_id", F.concat(F.lit("Study "), F.col("doc_id").cast("string")).alias("title"), F.expr(STUDY_TYPE).alias("evidence_type"),
        F.array(F.expr(DOC_SENTENCE), F.expr(DOC_SENTENCE_2), F.col("text")).alias("findings"),
        F.create_map(F.lit("population"), part(2), F.lit("intervention"), part(3), F.lit("comparison"), part(5),
                     F.lit("outcome"), F.col("source")).alias("pico"),
        effects.alias("effects"), F.col("source").alias("topic"))


STUDIES = f"""
studies AS (
  SELECT doc_id, 'Study ' || doc_id AS title, {STUDY_TYPE} AS evidence_type,
         {DOC_SENTENCE} || ' ' || {DOC_SENTENCE_2} || ' ' || text AS body,
         CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END AS population,
         CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS intervention,
         CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS comparison, source AS outcome, source AS topic, lang,
         doc_id % 4 <> 3 AS has_effects, {EFFECT_VALUE} AS v
  FROM documents)"""

# ---- operational tables -------------------------------------------------------------------

ARTICLE_STATUS = "(CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'parsed' END)"
TASK_STATUS = ("(CASE event_type WHEN 'view' THEN 'done' WHEN 'signup' THEN 'received' WHEN 'click' THEN 'parsing' "
               "WHEN 'error' THEN 'failed' ELSE 'partial' END)")
DEPARTMENT = pick("o_custkey", ["Cardiology", "Oncology", "Neurology", "Endocrinology", "Pediatrics", "Other"])


def articles(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    status = F.expr(ARTICLE_STATUS)
    return o.select(
        F.col("o_orderkey").alias("article_id"), F.concat(F.lit("Article "), F.col("o_orderkey").cast("string"), F.lit(" "),
                                                          F.col("o_orderpriority")).alias("title"),
        status.alias("status"), F.col("o_orderpriority").alias("article_type"), F.expr(DEPARTMENT).alias("department"),
        F.col("o_orderdate").alias("uploaded_at"), (status == "approved").alias("is_in_knowledge_base"),
        F.lit(None).cast("timestamp_ntz").alias("parsed_at"), F.lit(None).cast("timestamp_ntz").alias("approved_at"))


ARTICLES = f"""
articles AS (
  SELECT o_orderkey AS article_id, 'Article ' || o_orderkey || ' ' || o_orderpriority AS title, {ARTICLE_STATUS} AS status,
         o_orderpriority AS article_type, {DEPARTMENT} AS department, o_orderdate AS uploaded_at,
         {ARTICLE_STATUS} = 'approved' AS is_in_knowledge_base
  FROM orders)"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Article segments: order lines, numbered as they come within an order."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").cast("bigint").alias("sequence"),
                     F.concat(F.lit("segment "), F.col("l_partkey").cast("string")).alias("content"), "l_returnflag")


SEGMENTS = """
segments AS (
  SELECT l_orderkey AS article_id, l_linenumber::BIGINT AS sequence, 'segment ' || l_partkey AS content, l_returnflag
  FROM lineitem)"""


def figures(spark: SparkSession, sf: str) -> DataFrame:
    return segments(spark, sf).where(F.col("l_returnflag") == "R").select(
        "article_id", "sequence", F.concat(F.lit("figure in "), F.col("content")).alias("caption"))


FIGURES = """
figures AS (
  SELECT article_id, sequence, 'figure in ' || content AS caption FROM segments WHERE l_returnflag = 'R')"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + (conv_id * 60 + turn) * INTERVAL '1' MINUTE")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_no"), "role",
                    F.col("text").alias("content"), at.alias("created_at"))


MESSAGES = """
messages AS (
  SELECT conv_id AS session_id, turn AS message_no, role, text AS content,
         TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 60 + turn) * INTERVAL '1' MINUTE AS created_at
  FROM conversations)"""


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.md5(F.col("event_id").cast("string")).alias("task_uuid"), "event_id",
        F.concat(F.lit("file"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("filename"),
        F.md5(F.concat(F.col("user_id").cast("string"), F.lit("-"), (k % 3).cast("string"))).alias("file_md5"),
        F.expr(TASK_STATUS).alias("status"), F.col("user_id").alias("uploaded_by"), F.col("ts").alias("created_at"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("parsing_duration_ms"), (k % 5).alias("chunks_added"),
        (k == 7).alias("is_update"), (k % 5).alias("retry_count"), F.lit(3).cast("bigint").alias("max_retries"),
        F.lit("failed").alias("faiss_status"), F.lit("failed").alias("lightrag_status"),
        F.when(k % 13 != 0, F.lit("mineru25pro")).alias("engine_selected"))


TASKS = f"""
tasks AS (
  SELECT md5(event_id::VARCHAR) AS task_uuid, event_id, 'file' || user_id || '.pdf' AS filename,
         md5(user_id || '-' || (k % 3)) AS file_md5, {TASK_STATUS} AS status, user_id AS uploaded_by, ts AS created_at,
         floor(value * 1000)::BIGINT AS parsing_duration_ms, k % 5 AS chunks_added, k = 7 AS is_update,
         k % 5 AS retry_count, 3 AS max_retries, CASE WHEN k % 13 <> 0 THEN 'mineru25pro' END AS engine_selected
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))"""

# ---- graph --------------------------------------------------------------------------------

NODE_WORDS = ["myocardial infarction", "aspirin", "coronary stent", "RCT guideline", "CT scan", "chest pain",
              "coronary artery", "survival rate", "item"]
PART_LABEL = "(p_name || ' ' || " + pick("p_partkey", NODE_WORDS) + ")"
RELATION = pick("l_partkey + l_suppkey", ["treats", "causes", "related_to", "diagnoses"])


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and suppliers as entities; a part's label carries a medical term."""
    p = table(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.expr(PART_LABEL).alias("label"),
        F.col("p_size").cast("bigint").alias("weight"), F.col("p_partkey").alias("create_time"))
    s = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("label"),
        F.lit(1).cast("bigint").alias("weight"), F.col("s_suppkey").alias("create_time"))
    return p.unionByName(s).withColumn("grp", rules.entity_group("label"))


NODES = f"""
nodes AS (
  SELECT *, {sql_rules('label', rules.ENTITY_GROUP_RULES, 'other', fold=False)} AS grp FROM (
    SELECT 'P' || p_partkey AS id, {PART_LABEL} AS label, p_size::BIGINT AS weight, p_partkey AS create_time FROM part
    UNION ALL SELECT 'S' || s_suppkey, s_name, 1::BIGINT, s_suppkey FROM supplier))"""


def triples(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("source"),
                     F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target"),
                     F.col("l_orderkey").alias("chunk_id"), F.expr(RELATION).alias("relation_type"),
                     F.col("l_linenumber").cast("bigint").alias("seen_at"))


TRIPLES = f"""
triples AS (
  SELECT 'P' || l_partkey AS source, 'S' || l_suppkey AS target, l_orderkey AS chunk_id, {RELATION} AS relation_type,
         l_linenumber::BIGINT AS seen_at
  FROM lineitem)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return triples(spark, sf).groupBy("source", "target", "relation_type").agg(
        F.count(F.lit(1)).alias("weight"), F.max("chunk_id").alias("create_time"))


EDGES = TRIPLES + """,
edges AS (
  SELECT source, target, relation_type, count(*) AS weight, max(chunk_id) AS create_time
  FROM triples GROUP BY source, target, relation_type)"""

NOTE_LINK = r'<a href="/([^"]*)">'


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages as notes: each local link becomes a wiki link, the first title word the title."""
    p = text_table(spark, sf, "pages")
    return p.select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>([^ <]*)", 1).alias("title"),
                    F.regexp_replace("html", NOTE_LINK, "[[$1]] ").alias("content"))


NOTES = f"""
notes AS (
  SELECT page_id AS id, regexp_extract(html, '<title>([^ <]*)', 1) AS title,
         regexp_replace(html, '{NOTE_LINK}', '[[\\1]] ', 'g') AS content FROM pages),
note_links AS (
  SELECT DISTINCT id, lower(unnest(regexp_extract_all(
    regexp_replace(regexp_replace(content, '(?s)```.*?```', '', 'g'), '`[^`]*`', '', 'g'),
    '\\[\\[([^\\]]+)\\]\\]', 1))) AS link FROM notes)"""
