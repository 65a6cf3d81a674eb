"""Queries over evidence grading, consistency and the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import grading as G
from marginalia.functions import rules as R
from marginalia.functions.text import ENTITY_VOCABULARY, extract_entities
from marginalia.operators import evidence as E
from marginalia.operators import graph as K
from marginalia.operators import lookups as L
from marginalia.plans import inputs as I
from marginalia.plans.registry import query
from marginalia.plans.retrieval_queries import H, encode, passage_vectors, sql_text_query, stored_vectors

# ---- grading ------------------------------------------------------------------------------
LOW = "lower(body)"


def _case_sum(words: dict[str, list[str]]) -> str:
    return "(" + " + ".join(I.sql_any(LOW, [w.replace("'", "''") for w in ws]) + "::BIGINT" for ws in words.values()) + ")"


_PUB = [w.replace("'", "''") for w in G.PUBLICATION_BIAS_WORDS]
GRADED = I.STUDIES + f""",
effects AS (SELECT doc_id, CASE WHEN has_effects THEN [
   struct_pack(e := v, lo := v * 0.5, hi := v * (1 + doc_id % 7)), struct_pack(e := v + 0.7, lo := v * 0.25, hi := v * 2)] ELSE [] END AS ef FROM studies),
factors AS (SELECT s.*, ef, lower(replace(evidence_type, '-', '_')) AS et,
  greatest(-2, -{_case_sum(G.BIAS_WORDS)}) AS risk_of_bias,
  greatest(-2, -({I.sql_any(LOW, G.INCONSISTENCY_WORDS)}::BIGINT + {I.sql_any(LOW, G.I2_MARKS)}::BIGINT)) AS inconsistency,
  CASE WHEN (population = '')::INT + (intervention = '')::INT + (comparison = '')::INT + (outcome = '')::INT >= 2 THEN -1 ELSE 0 END AS indirectness,
  CASE WHEN len(list_filter(ef, lambda x: x.lo > 0 AND x.hi <> 0 AND x.hi / x.lo > 5)) > 0 THEN -1 ELSE 0 END AS imprecision,
  coalesce(list_filter(list_transform(list_filter(ef, lambda x: x.e > 0), lambda x: CASE WHEN x.e > 5 OR x.e < 0.2 THEN 2 WHEN x.e > 2 OR x.e < 0.5 THEN 1 END),
    lambda g: g IS NOT NULL)[1], 0) AS large_effect,
  {I.sql_any(LOW, G.DOSE_WORDS)} AS dose_words, {I.sql_any(LOW, G.ADJUSTMENT_WORDS)} AS adj_words, {I.sql_any(LOW, _PUB)} AS pub_words
  FROM studies s JOIN effects USING (doc_id)),
levels AS (SELECT *, CASE WHEN et IN ('meta_analysis', 'systematic_review', 'rct', 'randomized_controlled_trial') THEN 4 ELSE 2 END AS initial_level,
  CASE WHEN NOT pub_words AND et IN ('meta_analysis', 'systematic_review', 'meta分析', '系统综述') THEN -1 ELSE 0 END AS publication_bias FROM factors),
ups AS (SELECT *, CASE WHEN initial_level = 2 AND dose_words THEN 1 ELSE 0 END AS dose_response,
  CASE WHEN initial_level = 2 AND adj_words THEN 1 ELSE 0 END AS residual_confounding,
  risk_of_bias + inconsistency + indirectness + imprecision + publication_bias AS total_downgrade FROM levels),
finals AS (SELECT *, large_effect + dose_response + residual_confounding AS total_upgrade,
  greatest(1, least(4, initial_level + total_downgrade + large_effect + dose_response + residual_confounding)) AS final_level FROM ups),
graded AS (SELECT *, CASE final_level WHEN 4 THEN '高 (High)' WHEN 3 THEN '中 (Moderate)' WHEN 2 THEN '低 (Low)' ELSE '极低 (Very Low)' END AS final_label,
  CASE WHEN final_level >= 3 AND total_downgrade <= -1 THEN '强推荐' WHEN final_level >= 2 THEN '弱推荐' ELSE '不推荐(证据不足)' END AS recommendation FROM finals)"""


@query("initial_level", "WITH " + GRADED + " SELECT doc_id, initial_level::BIGINT AS initial_level FROM graded")
def initial_level(spark, sf):
    return I.studies(spark, sf).select("doc_id", G.initial_level(F.col("evidence_type")).alias("initial_level"))


def _factor_query(name, column):
    @query(name, "WITH " + GRADED + f" SELECT doc_id, {column}::BIGINT AS {column} FROM graded")
    def run(spark, sf):
        return E.assess_documents(I.studies(spark, sf)).select("doc_id", column)


for _name, _column in [("grade_risk_of_bias", "risk_of_bias"), ("grade_inconsistency", "inconsistency"),
                       ("grade_indirectness", "indirectness"), ("grade_imprecision", "imprecision"),
                       ("grade_publication_bias", "publication_bias"), ("grade_large_effect", "large_effect"),
                       ("grade_dose_response", "dose_response"), ("grade_residual_confounding", "residual_confounding")]:
    _factor_query(_name, _column)


@query("imprecision_details", "WITH " + I.STUDIES + """, d AS (SELECT doc_id, has_effects, body, v, v * 0.5 AS l1, v * (1 + doc_id % 7) AS h1, v * 0.25 AS l2, v * 2 AS h2 FROM studies),
n AS (SELECT *, (1 + doc_id % 7) / 0.5 > 5 AS w1, regexp_extract(lower(body), 'n\\.*=?\\.*(\\d+)', 1) AS num FROM d)
SELECT doc_id, (CASE WHEN has_effects THEN (CASE WHEN h1 / l1 > 5 THEN 1 ELSE (l1 < 1 AND h1 > 1)::INT + 1 END) ELSE 0 END
 + CASE WHEN (contains(lower(body), 'n=') OR contains(lower(body), 'n =') OR contains(body, '纳入') OR contains(lower(body), 'enrolled')) AND TRY_CAST(num AS DOUBLE) < 100 THEN 1 ELSE 0 END)::BIGINT AS details FROM n""")
def imprecision_details(spark, sf):
    s = I.studies(spark, sf)
    _, details = G.imprecision(F.array_join("findings", " "), F.col("effects"))
    return s.select("doc_id", F.size(details).alias("details"))


@query("assess_documents", "WITH " + GRADED + """
SELECT doc_id, initial_level::BIGINT AS initial_level, total_downgrade::BIGINT AS total_downgrade, total_upgrade::BIGINT AS total_upgrade,
  final_level::BIGINT AS final_level, final_label, recommendation FROM graded""")
def assess_documents(spark, sf):
    return E.assess_documents(I.studies(spark, sf)).select(
        "doc_id", "initial_level", "total_downgrade", "total_upgrade", "final_level", "final_label", "recommendation")


@query("apply_corrections", "WITH " + GRADED + """,
c AS (SELECT doc_id, toxic = 1 AS agree, quality - 1 AS rb FROM labels),
m AS (SELECT g.doc_id, initial_level, c.doc_id IS NOT NULL AND NOT agree AS ap, CASE WHEN c.doc_id IS NOT NULL AND NOT agree THEN rb ELSE risk_of_bias END AS rob,
  CASE WHEN c.doc_id IS NOT NULL AND NOT agree THEN 0 ELSE inconsistency END AS inc, indirectness, imprecision, publication_bias, total_upgrade, recommendation
  FROM graded g LEFT JOIN c ON c.doc_id = g.doc_id)
SELECT doc_id, rob::BIGINT AS risk_of_bias, greatest(1, least(4, initial_level + rob + inc + indirectness + imprecision + publication_bias + total_upgrade))::BIGINT AS final_level, recommendation FROM m""")
def apply_corrections(spark, sf):
    a = E.assess_documents(I.studies(spark, sf))
    c = I.table(spark, sf, "labels").select(
        "doc_id", (F.col("toxic") == 1).alias("agree"), (F.col("quality") - 1).alias("risk_of_bias"), F.lit(0).alias("inconsistency"),
        F.lit(None).cast("int").alias("imprecision"), F.lit("note").alias("note"))
    return E.apply_corrections(a, c).select("doc_id", "risk_of_bias", "final_level", "recommendation")


@query("grade_profile", "WITH " + GRADED + f""", p AS (SELECT topic, count(*) AS total_assessed, count(*) FILTER (final_level = 4) AS high, count(*) FILTER (final_level = 3) AS moderate,
 count(*) FILTER (final_level = 2) AS low, count(*) FILTER (final_level = 1) AS very_low FROM graded GROUP BY topic)
SELECT *, CASE WHEN high + moderate >= total_assessed * 0.5 THEN '{E.OVERALL_GOOD}' WHEN low > 0 THEN '{E.OVERALL_LIMITED}' ELSE '{E.OVERALL_LOW}' END AS overall FROM p""")
def grade_profile(spark, sf):
    return E.grade_profile(E.assess_documents(I.studies(spark, sf), keep=("topic",)), ["topic"])


_TEXT_LOW = "lower(body)"
#: Levels of texts ``b(..., body)`` that are graded by their words alone.
LEVELS_OF_TEXTS = f""",
l AS (SELECT *, {I.sql_rules('body', R.EVIDENCE_LABEL_RULES, None)} AS label FROM b),
f AS (SELECT * EXCLUDE (body), CASE WHEN lower(replace(label, '-', '_')) IN ('meta_analysis', 'rct') THEN 4 ELSE 2 END AS lv,
  greatest(-2, -{_case_sum(G.BIAS_WORDS)}) + greatest(-2, -({I.sql_any(_TEXT_LOW, G.INCONSISTENCY_WORDS)}::BIGINT + {I.sql_any(_TEXT_LOW, G.I2_MARKS)}::BIGINT)) - 1 AS down,
  {I.sql_any(_TEXT_LOW, G.DOSE_WORDS)}::BIGINT + {I.sql_any(_TEXT_LOW, G.ADJUSTMENT_WORDS)}::BIGINT AS up FROM l),
leveled AS (SELECT *, lv::BIGINT AS initial_level, down::BIGINT AS total_downgrade,
  greatest(1, least(4, lv + down + CASE WHEN lv = 2 THEN up ELSE 0 END))::BIGINT AS final_level FROM f)"""


def _estimate_sql(top: int, keep: int) -> str:
    return H + f""", b AS (SELECT query_id, string_agg(left(text, {keep}), ' ' ORDER BY rank) AS body FROM hits WHERE rank <= {top} GROUP BY query_id)
{LEVELS_OF_TEXTS} SELECT query_id AS doc_id, initial_level, total_downgrade, final_level FROM leveled"""


@query("estimate_grade", _estimate_sql(3, 1000))
def estimate_grade(spark, sf):
    return E.estimate_grade(I.hits(spark, sf, 20)).select("doc_id", "initial_level", "total_downgrade", "final_level")


@query("estimate_grade_topic", _estimate_sql(5, 600))
def estimate_grade_topic(spark, sf):
    return E.estimate_grade(I.hits(spark, sf, 20), top=5, keep=600, unlabelled="mixed").select(
        "doc_id", "initial_level", "total_downgrade", "final_level")


# what is asked for: no document, two names of which one is a passage's words, a name that finds nothing
NAMES_ASKED = """(CASE item_id % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['doc' || item_id, array_to_string(string_split(text, ' ')[1:4], ' ')]
  ELSE [repeat(' ', (item_id % 5)::INT)] END)"""
GRADE_REQUESTS = sql_text_query("asked", f"""SELECT text AS query_id, text FROM (SELECT DISTINCT unnest({NAMES_ASKED}) AS text FROM benchmark
  UNION SELECT text FROM benchmark)""", 5) + f""",
wanted AS (SELECT DISTINCT item_id AS request_id, unnest({NAMES_ASKED}) AS name FROM benchmark),
one AS (SELECT query_id AS name, string_agg(left(text, 1000), ' ' ORDER BY rank) AS body FROM thits WHERE rank <= 3 GROUP BY 1),
five AS (SELECT query_id AS topic, string_agg(left(text, 600), ' ' ORDER BY rank) AS body FROM thits GROUP BY 1),
named AS (SELECT request_id, name AS doc, body FROM wanted JOIN one USING (name)),
b AS (SELECT * FROM named UNION ALL
  SELECT item_id, '{E.WHOLE_TOPIC}', coalesce(body, '') FROM benchmark LEFT JOIN five ON topic = text WHERE item_id NOT IN (SELECT request_id FROM named))
{LEVELS_OF_TEXTS}"""


def _grade_requests(spark, sf):
    t, i = F.col("text"), F.col("item_id").cast("string")
    names = (F.when(F.col("item_id") % 3 == 0, F.array().cast("array<string>"))
             .when(F.col("item_id") % 3 == 1, F.array(F.concat(F.lit("doc"), i), F.array_join(F.slice(F.split(t, " "), 1, 4), " ")))
             .otherwise(F.array(F.repeat(F.lit(" "), (F.col("item_id") % 5).cast("int")))))
    requests = I.table(spark, sf, "benchmark").select(F.col("item_id").alias("request_id"), t.alias("topic"), names.alias("doc_names"))
    return E.grade_requests(requests, encode, stored_vectors(spark, sf), I.passage_rows(spark, sf))


@query("estimate_grade_requests", GRADE_REQUESTS + """
SELECT request_id, doc, initial_level, total_downgrade, final_level FROM leveled""")
def estimate_grade_requests(spark, sf):
    return _grade_requests(spark, sf).select("request_id", F.col("doc_id").alias("doc"), "initial_level", "total_downgrade", "final_level")


@query("estimate_grade_profile", GRADE_REQUESTS + f""", p AS (SELECT request_id, count(*) AS total_assessed, count(*) FILTER (final_level = 4) AS high,
  count(*) FILTER (final_level = 3) AS moderate, count(*) FILTER (final_level = 2) AS low, count(*) FILTER (final_level = 1) AS very_low FROM leveled GROUP BY 1)
SELECT *, CASE WHEN high + moderate >= total_assessed * 0.5 THEN '{E.OVERALL_GOOD}' WHEN low > 0 THEN '{E.OVERALL_LIMITED}' ELSE '{E.OVERALL_LOW}' END AS overall FROM p""")
def estimate_grade_profile(spark, sf):
    return E.grade_profile(_grade_requests(spark, sf), ["request_id"])


@query("grade_corpus", sql_text_query("asked", "SELECT 'doc' || doc_id AS query_id, 'doc' || doc_id AS text FROM documents", 3) + f""",
per AS (SELECT query_id AS name, string_agg(text, ' ' ORDER BY rank) AS body FROM thits GROUP BY 1),
b AS (SELECT 'doc' || doc_id AS doc, {I.STUDY_TYPE} AS et, coalesce(body, '') AS body FROM documents LEFT JOIN per ON name = 'doc' || doc_id),
pub AS (SELECT doc, CASE WHEN lower(replace(et, '-', '_')) IN ('meta_analysis', 'systematic_review', 'meta分析', '系统综述') AND NOT {I.sql_any('lower(body)', _PUB)}
  THEN -1 ELSE 0 END AS pub FROM b)
{LEVELS_OF_TEXTS},
g AS (SELECT *, CASE WHEN lower(replace(et, '-', '_')) IN ('meta_analysis', 'systematic_review', 'rct', 'randomized_controlled_trial') THEN 4 ELSE 2 END AS il, down + pub AS d
  FROM f JOIN pub USING (doc))
SELECT doc, il::BIGINT AS initial_level, d::BIGINT AS total_downgrade, greatest(1, least(4, il + d + CASE WHEN il = 2 THEN up ELSE 0 END))::BIGINT AS final_level FROM g""")
def grade_corpus(spark, sf):
    d = I.table(spark, sf, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_name"), F.expr(I.STUDY_TYPE).alias("evidence_type"))
    return E.grade_corpus(d, encode, passage_vectors(spark, sf), I.passage_rows(spark, sf)).select(
        F.col("doc_id").alias("doc"), "initial_level", "total_downgrade", "final_level")


# ---- consistency --------------------------------------------------------------------------
_T = "left(text, 500)"
_LEADS = f"({I.sql_count('lower(' + _T + ')', R.SUPPORT_WORDS)} - {I.sql_count('lower(' + _T + ')', R.AGAINST_WORDS)})"
FINDINGS = H + f""", findings AS (SELECT query_id, rank, source, {I.sql_rules(_T, R.MATRIX_LABEL_RULES, None)} AS evidence,
  CASE WHEN {_LEADS} > 1 THEN 'supportive' WHEN {_LEADS} < -1 THEN 'against' ELSE 'neutral' END AS direction, left(text, 200) AS quote FROM hits WHERE rank <= 8)"""


def _findings(spark, sf):
    return E.hit_findings(I.hits(spark, sf, 20))


@query("hit_findings", FINDINGS + " SELECT * FROM findings")
def hit_findings(spark, sf):
    return _findings(spark, sf).drop("effect")


VERDICT = f"""CASE WHEN documents < 2 THEN '{E.TOO_FEW}' WHEN supportive = documents THEN '{E.ALL_SUPPORT}' WHEN against = documents THEN '{E.ALL_AGAINST}'
 WHEN neutral = documents THEN '{E.ALL_NEUTRAL}' WHEN supportive > 0 AND against = 0 THEN '{E.PARTLY}' WHEN supportive > 0 AND against > 0 THEN '{E.CONTRADICTED}'
 ELSE '{E.UNCLEAR}' END AS consistency"""
READING = f"""CASE consistency WHEN '{E.TOO_FEW}' THEN NULL WHEN '{E.ALL_SUPPORT}' THEN documents || '篇文献结论方向一致，均支持该观点。证据链完整，结论可靠。'
 WHEN '{E.CONTRADICTED}' THEN supportive || '篇支持 vs ' || against || '篇反对。建议优先采信证据等级更高的文献结论，并关注矛盾的可能原因(样本量差异/研究设计差异/纳入人群差异)。'
 WHEN '{E.PARTLY}' THEN supportive || '篇支持，其余为中性结论。总体倾向于支持，但证据强度有限。' ELSE '{E.READ_OTHER}' END AS interpretation"""
COUNTS = ("count(*) AS documents, count(*) FILTER (direction = 'supportive') AS supportive, count(*) FILTER (direction = 'against') AS against, "
          "count(*) FILTER (direction = 'neutral') AS neutral")


@query("consistency_matrix", FINDINGS + f""", g AS (SELECT query_id, {COUNTS} FROM findings GROUP BY query_id), v AS (SELECT *, {VERDICT} FROM g)
SELECT *, {READING} FROM v""")
def consistency_matrix(spark, sf):
    return E.consistency_verdict(_findings(spark, sf))


DOC_TEXT = f"({I.DOC_SENTENCE} || {I.DOC_SENTENCE_2} || text)"
_DL = f"({I.sql_count('lower(' + DOC_TEXT + ')', R.SUPPORT_WORDS)} - {I.sql_count('lower(' + DOC_TEXT + ')', R.AGAINST_WORDS)})"


@query("consistency_verdict", f"""WITH f AS (SELECT n_chars AS topic, CASE WHEN {_DL} > 1 THEN 'supportive' WHEN {_DL} < -1 THEN 'against' ELSE 'neutral' END AS direction FROM documents),
g AS (SELECT topic, {COUNTS} FROM f GROUP BY topic), v AS (SELECT *, {VERDICT} FROM g) SELECT *, {READING} FROM v""")
def consistency_verdict(spark, sf):
    d = I.text_table(spark, sf, "documents")
    text = F.concat(F.expr(I.DOC_SENTENCE), F.expr(I.DOC_SENTENCE_2), F.col("text"))
    return E.consistency_verdict(d.select(F.col("n_chars").alias("topic"), R.direction(text).alias("direction")), "topic")


@query("evidence_distribution", FINDINGS + " SELECT query_id, coalesce(evidence, 'unknown') AS evidence, count(*) AS documents FROM findings GROUP BY 1, 2")
def evidence_distribution(spark, sf):
    return E.evidence_distribution(_findings(spark, sf))


@query("compare_pairs", FINDINGS + """, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE coalesce(evidence, 'unknown')
  WHEN 'Meta-analysis' THEN 0 WHEN 'RCT' THEN 1 WHEN 'Cohort' THEN 2 WHEN 'Case-control' THEN 3 WHEN 'Case-series' THEN 4 WHEN 'Expert-opinion' THEN 5 ELSE 6 END, rank, source) AS i FROM findings)
SELECT a.query_id, '文献' || a.i || ' vs 文献' || b.i AS pair, a.source AS doc_a, b.source AS doc_b, a.direction = b.direction AS direction_match,
 a.evidence AS evidence_a, b.evidence AS evidence_b, CASE WHEN a.direction = b.direction THEN '一致' ELSE '方向不一致: ' || a.direction || ' vs ' || b.direction END AS conflict
FROM o a JOIN o b ON a.query_id = b.query_id AND a.i < b.i""")
def compare_pairs(spark, sf):
    return E.compare_pairs(_findings(spark, sf))


# ---- evidence tables ----------------------------------------------------------------------
_LV = "(doc_id % 7 + 1)"


def _evidence(spark, sf):
    s = I.studies(spark, sf)
    return s.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_name"), F.col("title").alias("doc_title"),
                    (F.col("doc_id") % 7 + 1).cast("int").alias("evidence_level"), "pico", "findings")


@query("evidence_summary", f"""SELECT CASE {_LV} WHEN 1 THEN 'META_ANALYSIS' WHEN 2 THEN 'RCT' WHEN 3 THEN 'COHORT' WHEN 4 THEN 'CASE_CONTROL' WHEN 5 THEN 'CASE_REPORT'
 WHEN 6 THEN 'EXPERT_CONSENSUS' ELSE 'UNKNOWN' END AS level, count(*) AS documents FROM documents GROUP BY 1""")
def evidence_summary(spark, sf):
    return E.evidence_summary(_evidence(spark, sf))


@query("documents_by_level", f"""SELECT CASE {_LV} WHEN 1 THEN 'META_ANALYSIS' WHEN 2 THEN 'RCT' WHEN 3 THEN 'COHORT' WHEN 4 THEN 'CASE_CONTROL' WHEN 5 THEN 'CASE_REPORT'
 WHEN 6 THEN 'EXPERT_CONSENSUS' ELSE 'UNKNOWN' END AS level, doc_id::VARCHAR AS doc_title FROM documents""")
def documents_by_level(spark, sf):
    e = _evidence(spark, sf)
    return E.documents_by_level(e.withColumn("doc_title", F.substring("doc_name", 4, 20)))


@query("relation_summary", "WITH " + I.EDGES + " SELECT relation_type, count(*) AS relations FROM edges GROUP BY relation_type")
def relation_summary(spark, sf):
    return E.relation_summary(I.edges(spark, sf))


@query("evidence_overview", f"""WITH l AS (SELECT CASE {_LV} WHEN 1 THEN 'META_ANALYSIS' WHEN 2 THEN 'RCT' WHEN 3 THEN 'COHORT' WHEN 4 THEN 'CASE_CONTROL' WHEN 5 THEN 'CASE_REPORT'
 WHEN 6 THEN 'EXPERT_CONSENSUS' ELSE 'UNKNOWN' END AS level, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT l_orderkey * 10 + l_linenumber AS id, '  P' || l_partkey || ' --[' || {I.RELATION} || ']--> S' || l_suppkey AS line FROM lineitem ORDER BY id, line LIMIT 20)
SELECT '知识库共' || (SELECT count(*) FROM documents) || '篇文献' || chr(10) || (SELECT string_agg('证据等级' || level || ': ' || n || '篇', chr(10) ORDER BY level) FROM l WHERE level <> 'UNKNOWN')
 || chr(10) || chr(10) || '关键医学关系:' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY id) FROM r) AS overview""")
def evidence_overview(spark, sf):
    rel = I.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("relation_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("source"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target"), F.expr(I.RELATION).alias("relation_type"))
    return E.evidence_overview_text(_evidence(spark, sf), rel)


TOPICS = ["heterogeneity", "LVAD", "safety", "mortality", "src1", "und "]
TOPIC_MATCH = f"""topics AS (SELECT unnest([{', '.join(f"'{t}'" for t in TOPICS)}]) AS topic),
hay AS (SELECT 'doc' || doc_id AS doc_name, title, doc_id % 7 + 1 AS evidence_level,
  lower('{{"population":"' || population || '","intervention":"' || intervention || '","comparison":"' || comparison || '","outcome":"' || outcome || '"}}') AS p, lower(body) AS b FROM studies),
matches AS (SELECT doc_name, topic, evidence_level FROM hay, topics WHERE contains(p, lower(topic)) OR contains(b, lower(topic)))"""


@query("topic_evidence", "WITH " + I.STUDIES + "," + TOPIC_MATCH + " SELECT * FROM matches")
def topic_evidence(spark, sf):
    return L.topic_evidence(_evidence(spark, sf), TOPICS).select("doc_name", "topic", "evidence_level")


# keywords and topics as rows: pieces of the documents' own lines, tens of thousands of them
PIECE = "lower(substr(line, CAST(1 + (doc_id + line_no) % 9 AS INT), CAST(5 + line_no % 9 AS INT)))"


def _pieces(spark, sf):
    return I.lines(spark, sf).select((F.col("doc_id") * 100_000 + F.col("line_no")).alias("place"), F.concat(
        F.lit("L"), ((F.col("doc_id") + F.col("line_no")) % 7).cast("string")).alias("label"), F.expr(PIECE).alias("keyword"))


@query("classify_by_table", "WITH " + I.LINES + f""", p AS (SELECT doc_id * 100000 + line_no AS place, 'L' || ((doc_id + line_no) % 7) AS label, {PIECE} AS keyword FROM lines),
u AS (SELECT keyword, min(place) AS place FROM p WHERE keyword <> '' GROUP BY keyword),
d AS (SELECT doc_id, {I.DOC_SENTENCE} || reverse(text) || text AS t FROM documents),
m AS (SELECT doc_id, min(place) AS place FROM d JOIN u ON contains(lower(left(t, 300)), keyword) GROUP BY doc_id)
SELECT doc_id, coalesce(p.label, 'none') AS label FROM d LEFT JOIN m USING (doc_id) LEFT JOIN p ON p.place = m.place""")
def classify_by_table(spark, sf):
    d = I.text_table(spark, sf, "documents").select("doc_id", F.concat(F.expr(I.DOC_SENTENCE), F.reverse("text"), "text").alias("t"))
    return L.classify_by_table(d, _pieces(spark, sf), ["doc_id"], "t", "none", 300).select("doc_id", "label")


@query("topic_evidence_table", "WITH " + I.STUDIES + "," + I.LINES + f""", topics AS (SELECT DISTINCT {PIECE} AS topic FROM lines WHERE line_no = 0),
hay""" + TOPIC_MATCH.split("hay", 1)[1] + " SELECT * FROM matches")
def topic_evidence_table(spark, sf):
    topics = I.lines(spark, sf).where("line_no = 0").select(F.expr(PIECE).alias("topic")).distinct()
    return L.topic_evidence(_evidence(spark, sf), topics, ("evidence_level",)).select("doc_name", "topic", "evidence_level")


@query("best_topic_evidence", "WITH " + I.STUDIES + "," + TOPIC_MATCH + """
SELECT topic, doc_name, evidence_level FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY evidence_level, doc_name) AS rn FROM matches) WHERE rn = 1""")
def best_topic_evidence(spark, sf):
    return L.best_topic_evidence(L.topic_evidence(_evidence(spark, sf), TOPICS).select("topic", "doc_name", "evidence_level"))


@query("document_percents", "WITH " + I.CHUNKS + """, n AS (SELECT doc_name, chunk_idx, regexp_extract_all(text, '(\\d+\\.?\\d*)\\s*[%％]', 1)[1:5] AS a FROM chunks),
u AS (SELECT doc_name, chunk_idx, unnest(a) AS value, generate_subscripts(a, 1) - 1 AS pos FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_name ORDER BY chunk_idx, pos) AS rank FROM u) SELECT * FROM r WHERE rank <= 10""")
def document_percents(spark, sf):
    return E.document_percents(I.chunks(spark, sf))


# ---- graph --------------------------------------------------------------------------------
NE = "WITH " + I.NODES + "," + I.EDGES


def _entities(spark, sf):
    n = I.nodes(spark, sf)
    return n.select(F.col("id").alias("name"), F.when(F.col("weight") > 1, F.col("weight")).alias("count"), "create_time",
                    F.array().cast("array<string>").alias("chunk_ids"))


@query("build_nodes", "WITH " + I.NODES + f"""
SELECT id, id AS label, {I.sql_rules('id', R.ENTITY_GROUP_RULES, 'other', fold=False)} AS grp, greatest(weight, 1) AS weight, create_time FROM nodes""")
def build_nodes(spark, sf):
    return K.build_nodes(_entities(spark, sf)).drop("chunk_ids")


@query("build_edges", "WITH " + I.EDGES + " SELECT source, target, weight, create_time, relation_type FROM edges")
def build_edges(spark, sf):
    return K.build_edges(I.edges(spark, sf).withColumnRenamed("weight", "count"))


@query("graph_snapshot", NE + " SELECT greatest((SELECT max(create_time) FROM nodes), (SELECT max(create_time) FROM edges)) AS since")
def graph_snapshot(spark, sf):
    return K.graph_snapshot(I.nodes(spark, sf), I.edges(spark, sf))


@query("graph_delta", NE + " SELECT source, target, relation_type, create_time FROM edges WHERE create_time > (SELECT max(create_time) FROM nodes)")
def graph_delta(spark, sf):
    n = I.nodes(spark, sf)
    at_nodes = n.agg(F.max("create_time").alias("since"))
    return K.graph_delta(I.edges(spark, sf), at_nodes).select("source", "target", "relation_type", "create_time")


@query("degree", NE + """, p AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edges WHERE source <> target),
d AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY id)
SELECT nodes.id, coalesce(n, 0) AS degree FROM nodes LEFT JOIN d USING (id)""")
def degree(spark, sf):
    return K.degree(I.nodes(spark, sf), I.edges(spark, sf))


@query("graph_integrity", NE + f"""
SELECT 'unique_ids' AS check, (SELECT count(*) FROM (SELECT id FROM nodes GROUP BY id HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'source_exists', (SELECT count(*) FROM edges WHERE source NOT IN (SELECT id FROM nodes))
UNION ALL SELECT 'target_exists', (SELECT count(*) FROM edges WHERE target NOT IN (SELECT id FROM nodes))
UNION ALL SELECT 'no_self_loops', (SELECT count(*) FROM edges WHERE source = target)
UNION ALL SELECT 'positive_weight', (SELECT count(*) FROM edges WHERE weight <= 0)
UNION ALL SELECT 'known_group', (SELECT count(*) FROM nodes WHERE grp NOT IN ({', '.join(f"'{g}'" for g in R.ENTITY_GROUPS)}))""")
def graph_integrity(spark, sf):
    return K.graph_integrity(I.nodes(spark, sf), I.edges(spark, sf))


@query("graph_stats", NE + """
SELECT 'node_type' AS kind, grp AS name, count(*) AS n FROM nodes GROUP BY grp UNION ALL SELECT 'edge_type', relation_type, count(*) FROM edges GROUP BY relation_type
UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges
UNION ALL SELECT 'total', 'entity_types', count(DISTINCT grp) FROM nodes UNION ALL SELECT 'total', 'docs', count(DISTINCT source) FROM documents""")
def graph_stats(spark, sf):
    docs = I.text_table(spark, sf, "documents").select(F.col("source").alias("file_path"), F.col("doc_id").cast("string").alias("doc_key"))
    return K.graph_stats(I.nodes(spark, sf), I.edges(spark, sf), docs)


@query("list_top_nodes", "WITH " + I.NODES + " SELECT id, label, weight FROM nodes WHERE grp = 'drug' AND contains(lower(label), 'ring') ORDER BY weight DESC, id LIMIT 20")
def list_top_nodes(spark, sf):
    return K.list_top_nodes(I.nodes(spark, sf), "drug", "ring").select("id", "label", "weight")


@query("node_neighborhood", NE + """, w AS (SELECT id FROM nodes WHERE grp = 'drug' OR starts_with(id, 'S'))
SELECT source AS node, 'out' AS direction, target AS neighbor, weight FROM edges WHERE source IN (SELECT id FROM w)
UNION ALL SELECT target, 'in', source, weight FROM edges WHERE target IN (SELECT id FROM w)""")
def node_neighborhood(spark, sf):
    wanted = I.nodes(spark, sf).where((F.col("grp") == "drug") | F.startswith("id", F.lit("S"))).select("id")
    return L.node_neighborhood(I.edges(spark, sf), wanted)


@query("induced_subgraph", NE + """, a AS (SELECT id FROM nodes WHERE contains(lower(label), 'r'))
SELECT source, target, relation_type FROM edges WHERE source IN (SELECT id FROM a) AND target IN (SELECT id FROM a)""")
def induced_subgraph(spark, sf):
    return L.induced_subgraph(I.nodes(spark, sf), I.edges(spark, sf), "R").select("source", "target", "relation_type")


ENTITY_ROWS = I.CHUNKS + f""", ce AS (SELECT unnest(list_filter([{', '.join(f"'{v}'" for v in ENTITY_VOCABULARY)}],
  lambda v: contains(lower(text), lower(v)))[1:10]) AS entity, doc_name || '#' || chunk_idx AS chunk_id, page_idx AS seen_at FROM chunks)"""


def _chunk_entities(spark, sf):
    c = I.chunks(spark, sf)
    return c.select(F.explode(extract_entities("text")).alias("entity"),
                    F.concat(F.col("doc_name"), F.lit("#"), F.col("chunk_idx").cast("string")).alias("chunk_id"), F.col("page_idx").alias("seen_at"))


@query("entity_index", "WITH " + ENTITY_ROWS + " SELECT entity, count(DISTINCT chunk_id) AS count, min(seen_at) AS create_time FROM ce GROUP BY entity")
def entity_index(spark, sf):
    return K.entity_index(_chunk_entities(spark, sf))


@query("entity_chunks", "WITH " + ENTITY_ROWS + " SELECT entity, chunk_id, min(seen_at) AS seen_at FROM ce GROUP BY entity, chunk_id")
def entity_chunks(spark, sf):
    return K.entity_chunks(_chunk_entities(spark, sf))


@query("relation_index", "WITH " + I.TRIPLES + " SELECT source, target, count(DISTINCT chunk_id) AS count FROM triples GROUP BY source, target")
def relation_index(spark, sf):
    return K.relation_index(I.triples(spark, sf).select("source", "target", "chunk_id"))


@query("add_relations", "WITH " + I.EDGES + """
SELECT source, target, relation_type, 7::BIGINT AS evidence_level, 0.5::DOUBLE AS confidence, '' AS source_doc FROM edges
UNION ALL SELECT c_name, c_mktsegment, 'related_to', 7, 0.5, '' FROM customer""")
def add_relations(spark, sf):
    base = I.edges(spark, sf).select("source", "target", "relation_type", F.lit(7).alias("evidence_level"), F.lit(0.5).alias("confidence"), F.lit("").alias("source_doc"))
    fresh = I.table(spark, sf, "customer").select(F.col("c_name").alias("source"), F.col("c_mktsegment").alias("target"), F.lit("buys").alias("relation_type"))
    return K.add_relations(base, fresh)


WIKI = "WITH " + I.NOTES + """, by_title AS (SELECT lower(title) AS link, max(id) AS target FROM notes GROUP BY 1),
we AS (SELECT DISTINCT least(id, target) AS a, greatest(id, target) AS b FROM note_links JOIN by_title USING (link) WHERE id <> target)"""


@query("wiki_graph", WIKI + """, d AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM we UNION ALL SELECT b FROM we) GROUP BY id)
SELECT notes.id, title, coalesce(n, 0) AS link_count FROM notes LEFT JOIN d USING (id)""")
def wiki_graph(spark, sf):
    return L.wiki_graph(I.notes(spark, sf))


@query("wiki_edges", WIKI + " SELECT a, b FROM we")
def wiki_edges(spark, sf):
    return L.wiki_edges(I.notes(spark, sf))


@query("backlinks", "WITH " + I.NOTES + " SELECT DISTINCT t.title, l.id FROM note_links l JOIN (SELECT DISTINCT title FROM notes) t ON lower(t.title) = l.link")
def backlinks(spark, sf):
    n = I.notes(spark, sf)
    return L.backlinks(n, n.select("title"))
