"""Queries over cleaning, projection and rule-classification operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import analysis as A
from marginalia.functions import rules as R
from marginalia.functions import text as T
from marginalia.operators import ingest, lookups
from marginalia.plans import inputs as I
from marginalia.plans.registry import query

LI = "WITH " + I.LINES
KEY = "doc_name, line_no"


def _lines(spark, sf, **cols):
    return I.lines(spark, sf).select("doc_name", "line_no", *[c.alias(n) for n, c in cols.items()])




def sentence():
    return F.concat(F.expr(I.LINE_SENTENCE), F.col("line"))


SENT_SQL = f"({I.LINE_SENTENCE} || line)"

HEADERS = ["Downloaded from site on May 2019 ", "BRIEF COMMUNICATION Genetics inMedicine ", "Heart Vol. 12 p 1998",
           "JACC Vol. 52, No. 19, 2008\nNovember:1584-8 2008:1584-1588 ", "plain "]
HEADED = I.pick("doc_id + line_no", [h.replace("\n", "~") for h in HEADERS])


@query("clean_page", LI + f"""
SELECT {KEY}, {I.sql_strip('''regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(h, '~', chr(10)),
  '(?i)JACC\\s+Vol\\.\\s+\\d+,\\s+No\\.\\s+\\d+,\\s+\\d{4}\\s*\\n.+?\\d{4}:\\d+[-–]\\d+', '', 'g'),
  '(?i)Seyfarth et al\\.\\s*\\nLVAD Versus IABP in Cardiogenic Shock', '', 'g'),
  '(?is)Downloaded from.*?on.*?\\d{4}', '', 'g'),
  '(?i)(?:BRIEF|ORIGINAL|CLINICAL|RESEARCH|REVIEW)\\s+(?:COMMUNICATION|ARTICLE|REPORT|PAPER|LETTER)\\s+[\\pL\\pN_\\s]+(?:inMedicine|in\\s+Medicine|Medicine)', '', 'g'),
  '(?im)^[\\pL\\pN_\\s]+Vol\\.\\s+\\d+.*?\\d{4}$', '', 'g')''')} AS cleaned
FROM (SELECT *, {HEADED} || chr(10) || line AS h FROM lines)""")
def clean_page(spark, sf):
    headed = F.concat(F.replace(F.expr(HEADED), F.lit("~"), F.lit("\n")), F.lit("\n"), F.col("line"))
    return _lines(spark, sf, cleaned=T.clean_page(headed))


OCR = I.pick("doc_id + line_no", ["a/zero.pl.tnum5 ", "/one.caseb ", "glyph&lt;31&gt; ", "/A.cap  bc ", "\\\\u00e9 ", "�� ", "ok "])
OCR_SQL = OCR.replace("\\\\", "\\")


@query("clean_ocr", LI + f""", r AS (SELECT *, {OCR_SQL} || line AS raw FROM lines), c AS (
SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw,
  '/zero\\.pl\\.tnum', '0', 'g'), '/one\\.case', '1', 'g'), 'glyph&lt;\\d+&gt;', '', 'g'), '/A\\.cap\\s*', 'A', 'g'),
  '\\\\u[0-9a-fA-F]{{4}}', '', 'g'), '�+', '', 'g') AS cleaned FROM r)
SELECT {KEY}, cleaned, cleaned <> raw AS changed FROM c""")
def clean_ocr(spark, sf):
    raw = F.concat(F.expr(OCR), F.col("line"))
    return _lines(spark, sf, raw=raw, cleaned=T.clean_ocr(raw)).select(
        "doc_name", "line_no", "cleaned", (F.col("cleaned") != F.col("raw")).alias("changed"))


@query("min_length_filter", "WITH " + I.ITEMS + f"""
SELECT doc_name, item_idx, type FROM items
WHERE (type = 'text' AND length({I.sql_strip('text')}) >= 10) OR type IN ('image', 'table', 'equation')""")
def min_length_filter(spark, sf):
    return ingest.preprocess_items(I.items(spark, sf)).select("doc_name", "item_idx", "type")


REPEATED = "repeat('loop ', CAST(CASE WHEN (doc_id + line_no) % 4 = 0 THEN 45 ELSE 3 END AS INT))"


@query("is_generation_loop", LI + f"""
SELECT {KEY}, {I.sql_loop("(" + REPEATED + " || line)")} AS looped FROM lines""")
def is_generation_loop(spark, sf):
    return _lines(spark, sf, looped=T.is_generation_loop(F.concat(F.expr(REPEATED), F.col("line"))))


@query("noise_ratio", f"SELECT doc_id, round({I.sql_noise('text')}, 6) AS noise FROM documents WHERE length(text) > 0")
def noise_ratio(spark, sf):
    d = I.text_table(spark, sf, "documents").where(F.length("text") > 0)
    return d.select("doc_id", T.noise_ratio("text").alias("noise"))


@query("quality_gate", "WITH " + I.CHUNKS + " SELECT doc_name, chunk_idx, type FROM gated")
def quality_gate(spark, sf):
    return ingest.quality_gate(ingest.items_to_chunks(I.items(spark, sf))).select("doc_name", "chunk_idx", "type")


@query("content_md5", "SELECT doc_id, md5(text) AS content_md5 FROM documents")
def content_md5(spark, sf):
    return I.text_table(spark, sf, "documents").select("doc_id", T.content_md5("text").alias("content_md5"))


@query("item_to_chunk", "WITH " + I.CHUNKS + " SELECT doc_name, chunk_idx, type, text, source, content_md5 FROM hashed")
def item_to_chunk(spark, sf):
    return ingest.items_to_chunks(I.items(spark, sf)).select(
        "doc_name", "chunk_idx", "type", "text", "source", "content_md5")


CHART = I.pick("doc_id + line_no", ["flowchart", "baseline_table", "km_curve", "other", "forest_plot", "outcome_table"])


@query("analysed_image_chunks", LI + f""", a AS (SELECT *, {CHART} AS ct, 'img' || line_no AS f FROM lines)
SELECT {KEY}, '[图表-VLM分析] ' || CASE ct WHEN 'flowchart' THEN '流程图 图表 图 诊断' WHEN 'baseline_table' THEN '基线 表格 表'
  WHEN 'km_curve' THEN '生存曲线 图表 图' WHEN 'forest_plot' THEN '森林图 图表 图' WHEN 'outcome_table' THEN '结局 表格 表'
  ELSE '图表 图 表格' END || ' 类型:' || ct || chr(10) || line || chr(10) || doc_name AS text,
  '/images/' || f || '.png' AS image_url, true AS vlm_analyzed FROM a""")
def analysed_image_chunks(spark, sf):
    b = I.lines(spark, sf).select(
        "doc_name", F.col("line_no").alias("item_idx"), F.lit("image").alias("type"), F.lit(0).alias("page_idx"),
        F.lit("").alias("text"), F.array("line").alias("image_caption"), F.lit(None).cast("array<string>").alias("table_caption"),
        F.lit("").alias("table_body"), F.concat(F.lit("/x/img"), F.col("line_no").cast("string"), F.lit(".png")).alias("img_path"),
        F.struct(F.expr(CHART).alias("chart_type"), F.col("line").alias("summary"), F.col("doc_name").alias("description")).alias("analysis"))
    return ingest.items_to_chunks(b, "analysis").select(
        "doc_name", F.col("chunk_idx").alias("line_no"), "text", "image_url", "vlm_analyzed")


@query("chart_keywords", LI + f"""
SELECT ct AS chart_type, kw AS keywords, count(*) AS n FROM (SELECT {CHART} AS ct, CASE {CHART} WHEN 'flowchart' THEN '流程图 图表 图 诊断'
 WHEN 'baseline_table' THEN '基线 表格 表' WHEN 'km_curve' THEN '生存曲线 图表 图' WHEN 'forest_plot' THEN '森林图 图表 图'
 WHEN 'outcome_table' THEN '结局 表格 表' ELSE '图表 图 表格' END AS kw FROM lines) GROUP BY 1, 2""")
def chart_keywords(spark, sf):
    return _lines(spark, sf, chart_type=F.expr(CHART)).groupBy(
        "chart_type", T.chart_keywords("chart_type").alias("keywords")).agg(F.count(F.lit(1)).alias("n"))


@query("source_labels", "WITH " + I.ITEMS + """, s AS (SELECT doc_name, item_idx, doc_name || ' [p.' || page_idx ||
  CASE type WHEN 'image' THEN ', image' WHEN 'table' THEN ', table' ELSE '' END || ']' AS source FROM items)
SELECT doc_name, item_idx, source, split_part(source, ' [p.', 1) AS doc,
  TRY_CAST(nullif(regexp_extract(source, 'p\\.(\\d+)\\]', 1), '') AS BIGINT) AS page FROM s""")
def source_labels(spark, sf):
    s = I.items(spark, sf).select("doc_name", "item_idx", T.format_source("doc_name", "page_idx", "type").alias("source"))
    return s.select("*", T.source_doc("source").alias("doc"), T.source_page("source").alias("page"))


@query("enrich_text", LI + f""", s AS (SELECT {KEY}, CASE WHEN line_no % 3 = 0 THEN '' ELSE doc_name END AS t, line,
  CASE WHEN line_no % 2 = 0 THEN lang ELSE '' END AS o, CASE WHEN line_no % 4 = 0 THEN [lang, source] ELSE [] END AS e FROM lines)
SELECT {KEY}, array_to_string(list_filter([CASE WHEN t <> '' THEN '[文献] ' || t END, line,
  CASE WHEN o <> '' THEN '[摘要] ' || o END, CASE WHEN len(e) > 0 THEN '[实体] ' || array_to_string(e, ', ') END],
  lambda x: x IS NOT NULL), chr(10)) AS enriched FROM s""")
def enrich_text(spark, sf):
    n = F.col("line_no")
    return _lines(spark, sf, enriched=T.enrich_text(
        F.when(n % 3 == 0, "").otherwise(F.col("doc_name")), "line",
        F.when(n % 2 == 0, F.col("lang")).otherwise(""),
        F.when(n % 4 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))))


META_HEAD = I.pick("doc_id", ["A randomized trial of care\nJournal of Cardiology 2008\nSmith A, Jones B, Wu C, Li D, Roy E\n",
                              "Evaluate this versus that one\nHeart Circulation Vol 1999\n", "nothing here\n"]).replace("\n", "~")
META_TEXT = f"(replace({META_HEAD}, '~', chr(10)) || text)"


@query("extract_doc_meta", f"""
WITH p AS (SELECT doc_id, {META_TEXT} AS page FROM documents),
l AS (SELECT doc_id, page, list_filter(list_transform(string_split(page, chr(10)), lambda x: {I.sql_strip('x')}), lambda x: length(x) > 10) AS ls FROM p)
SELECT doc_id,
  coalesce(left(list_filter(ls[1:10], lambda x: {I.sql_any('lower(x)', T.TITLE_WORDS)})[1], 200), 'doc' || doc_id) AS title,
  coalesce(left(list_filter(ls[1:5], lambda x: {I.sql_any('x', T.JOURNAL_WORDS)})[1], 100), '') AS journal,
  regexp_extract(left(page, 500), '\\b(?:19|20)\\d{{2}}\\b') AS year,
  coalesce(left(list_filter(ls, lambda x: length(x) - length(replace(x, ',', '')) >= 4 AND regexp_matches(left(x, 5), '\\p{{Lu}}'))[1], 200), '') AS authors
FROM l""")
def extract_doc_meta(spark, sf):
    d = I.text_table(spark, sf, "documents")
    page = F.concat(F.replace(F.expr(META_HEAD), F.lit("~"), F.lit("\n")), F.col("text"))
    return d.select("doc_id", T.doc_meta(page, F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("m")).select("doc_id", "m.*")


VOCAB_SQL = "[" + ", ".join(f"'{v}'" for v in T.ENTITY_VOCABULARY) + "]"


@query("extract_entities", LI + f"""
SELECT {KEY}, array_to_string(list_filter({VOCAB_SQL}, lambda v: contains(lower({SENT_SQL}), lower(v)))[1:10], '|') AS entities FROM lines""")
def extract_entities(spark, sf):
    return _lines(spark, sf, entities=T.extract_entities(sentence()))


@query("one_liner", f"""
WITH s AS (SELECT doc_id, text, {I.sql_strip("replace(left(string_split_regex(text, '[.!?]\\s+')[1], 150), chr(10), ' ')")} AS f FROM documents)
SELECT doc_id, CASE WHEN f <> '' THEN f ELSE {I.sql_strip("replace(left(text, 120), chr(10), ' ')")} END AS one_liner FROM s""")
def one_liner(spark, sf):
    return I.text_table(spark, sf, "documents").select("doc_id", T.one_liner("text").alias("one_liner"))


FENCED = ("(CASE doc_id % 4 WHEN 0 THEN '```json' || chr(10) || j || chr(10) || '```' WHEN 1 THEN 'Sure: ```json' || j || '``` done' "
          "WHEN 2 THEN j ELSE 'not json ' || lang END)")


@query("parse_fenced_json", f"""
WITH j AS (SELECT doc_id, lang, '{{"n": ' || n_chars || ', "lang": "' || lang || '"}}' AS j FROM documents),
r AS (SELECT doc_id, {FENCED} AS resp, j FROM j)
SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN json_extract_string(j, '$.n')::BIGINT END AS n,
  CASE WHEN doc_id % 4 < 3 THEN json_extract_string(j, '$.lang') END AS lang,
  CASE WHEN doc_id % 4 = 3 THEN resp END AS raw_response, CASE WHEN doc_id % 4 = 3 THEN 'JSON parse failed' END AS error FROM r""")
def parse_fenced_json(spark, sf):
    d = I.text_table(spark, sf, "documents").withColumn("j", F.to_json(F.struct(F.col("n_chars").alias("n"), "lang")))
    p = d.select("doc_id", T.parse_fenced_json(F.expr(FENCED), "n bigint, lang string").alias("p"))
    return p.select("doc_id", "p.value.n", "p.value.lang", "p.raw_response", "p.error")


def _analysis(spark, sf):
    d = I.text_table(spark, sf, "documents")
    n = F.col("n_chars").cast("string")
    outcome = lambda i: F.struct(
        F.concat(F.lit(f"outcome{i} "), F.col("lang")).alias("outcome_name"), F.lit("HR").alias("effect_measure"), n.alias("effect_value"),
        F.lit("0.5").alias("ci_lower"), F.lit("0.9").alias("ci_upper"), F.when(F.col("doc_id") % 2 == 0, "0.01").alias("p_value"))
    row = lambda i: F.struct(F.lit(f"var{i}").alias("variable"), n.alias("group1_value"), F.col("source").alias("group2_value"),
                             F.lit("0.2").alias("p_value"))
    kind = F.expr(I.pick("doc_id", ["baseline_table", "outcome_table", "km_curve"]))
    k = (F.col("doc_id") % 18 + 1).cast("int")
    return d.select("doc_id", F.struct(
        kind.alias("chart_type"), F.col("lang").alias("summary"), F.lit("d").alias("description"),
        F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source")).alias("study_groups"),
        (F.col("n_chars") % 3).alias("total_patients"), F.array_repeat(outcome(1), k).alias("outcomes"),
        F.array_repeat(row(1), k).alias("characteristics"), F.lit(None).cast("string").alias("error")).alias("a"),
        F.expr(I.pick("doc_id", ["baseline_characteristics", "outcome_measures", "other"])).alias("kind"))


OUT_LINE = "'outcome1 ' || lang || ': HR=' || n_chars || ', 95%CI 0.5-0.9, p=' || CASE WHEN doc_id % 2 = 0 THEN '0.01' ELSE '' END"
CHAR_LINE = "'var1: 组1=' || n_chars || ', 组2=' || source || ', p=0.2'"


@query("outcome_rows", f"""
SELECT doc_id, pos, CASE doc_id % 3 WHEN 0 THEN {CHAR_LINE} ELSE {OUT_LINE} END AS line
FROM (SELECT *, unnest(range(least(doc_id % 18 + 1, 15))) AS pos FROM documents WHERE doc_id % 3 < 2)""")
def outcome_rows(spark, sf):
    return _analysis(spark, sf).select("doc_id", F.posexplode(A.analysis_lines(F.col("a"))).alias("pos", "line"))


@query("outcome_html", f"""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<table><tr><th>变量</th><th>组1</th><th>组2</th><th>p值</th></tr>' ||
  repeat('<tr><td>var1</td><td>' || n_chars || '</td><td>' || source || '</td><td>0.2</td></tr>', least(doc_id % 18 + 1, 20)) || '</table>'
 WHEN 1 THEN '<table><tr><th>结局</th><th>效应量</th><th>95%CI</th><th>p值</th></tr>' || repeat('<tr><td>outcome1 ' || lang || '</td><td>HR ' ||
  n_chars || '</td><td>0.5-0.9</td><td>' || CASE WHEN doc_id % 2 = 0 THEN '0.01' ELSE '' END || '</td></tr>', least(doc_id % 18 + 1, 20)) || '</table>'
 ELSE '' END AS html FROM documents""")
def outcome_html(spark, sf):
    return _analysis(spark, sf).select("doc_id", A.analysis_html(F.col("a")).alias("html"))


@query("enhanced_caption", """
SELECT doc_id, CASE doc_id % 3
  WHEN 0 THEN CASE WHEN doc_id % 5 = 0 AND n_chars % 3 = 0 THEN '基线特征表' ELSE array_to_string(list_filter([
    CASE WHEN doc_id % 5 <> 0 THEN '研究分组: ' || lang || ' vs ' || source END,
    CASE WHEN n_chars % 3 > 0 THEN '总例数: ' || (n_chars % 3) END], lambda x: x IS NOT NULL), '. ') END
  WHEN 1 THEN array_to_string(list_transform(range(doc_id % 18 + 1), lambda i: 'outcome1 ' || lang || ': HR=' || n_chars || ', 95%CI [0.5-0.9], p=' ||
    CASE WHEN doc_id % 2 = 0 THEN '0.01' ELSE '' END), '; ')
  ELSE lang END AS caption FROM documents""")
def enhanced_caption(spark, sf):
    return _analysis(spark, sf).select("doc_id", A.enhanced_caption(F.col("a"), F.col("kind")).alias("caption"))


@query("extract_percents", LI + f"""
SELECT {KEY}, array_to_string(regexp_extract_all({SENT_SQL}, '(\\d+\\.?\\d*)\\s*[%％]', 1)[1:5], '|') AS percents FROM lines""")
def extract_percents(spark, sf):
    return _lines(spark, sf, percents=T.percents(sentence()))


NAMED = "(?i)(HR|RR|OR)\\s*[=＝]\\s*([\\d.]+)\\s*\\(\\s*([\\d.]+)\\s*[-–]\\s*([\\d.]+)\\s*\\)"
TRAILING = "(?i)([\\d.]+)\\s*\\(\\s*([\\d.]+)\\s*[-–]\\s*([\\d.]+)\\s*\\).*?(HR|RR|OR)"


@query("extract_effect", LI + f""", s AS (SELECT {KEY}, {SENT_SQL} AS t FROM lines), m AS (
SELECT *, regexp_matches(t, '{NAMED}') AS n, regexp_matches(t, '{TRAILING}') AS r FROM s)
SELECT {KEY}, CASE WHEN n THEN upper(regexp_extract(t, '{NAMED}', 1)) WHEN r THEN upper(regexp_extract(t, '{TRAILING}', 4)) END AS measure,
 TRY_CAST(CASE WHEN n THEN regexp_extract(t, '{NAMED}', 2) WHEN r THEN regexp_extract(t, '{TRAILING}', 1) END AS DOUBLE) AS value,
 TRY_CAST(CASE WHEN n THEN regexp_extract(t, '{NAMED}', 3) WHEN r THEN regexp_extract(t, '{TRAILING}', 2) END AS DOUBLE) AS lower,
 TRY_CAST(CASE WHEN n THEN regexp_extract(t, '{NAMED}', 4) WHEN r THEN regexp_extract(t, '{TRAILING}', 3) END AS DOUBLE) AS upper FROM m""")
def extract_effect(spark, sf):
    e = _lines(spark, sf, e=T.effect(sentence()))
    return e.select("doc_name", "line_no", "e.measure", "e.value", "e.lower", "e.upper")


@query("refine_query", f"""SELECT item_id, array_to_string(list_filter(string_split_regex(replace(replace(text, '？', ''), '?', ''), '\\s+'),
 lambda w: w <> '')[1:5], ' ') AS refined FROM benchmark""")
def refine_query(spark, sf):
    return I.table(spark, sf, "benchmark").select("item_id", T.refine_query("text").alias("refined"))


@query("preview_text", "WITH " + I.ITEMS + f"""
SELECT doc_name, item_idx, 'text' AS type, left({I.sql_strip('text')}, 300) AS preview,
  {I.sql_rules(I.sql_strip('text'), R.SECTION_RULES, 'unknown', 300)} AS section_tag, page_idx AS page,
  length({I.sql_strip('text')}) AS length FROM items WHERE type = 'text' AND length({I.sql_strip('text')}) > 30
UNION ALL SELECT doc_name, item_idx, 'table', cap || chr(10) || left(table_body, 200), NULL, page_idx, NULL FROM items WHERE type = 'table'""")
def preview_text(spark, sf):
    return ingest.preview_text(I.items(spark, sf))


@query("preview_images", "WITH " + I.ITEMS + """
SELECT doc_name, item_idx, left(cap, 200) AS caption, page_idx AS page FROM items WHERE type = 'image' AND cap <> ''""")
def preview_images(spark, sf):
    return ingest.preview_images(I.items(spark, sf))


@query("first_pages_text", "WITH " + I.PAGES + """, f AS (SELECT *, row_number() OVER (PARTITION BY doc_name ORDER BY page_idx) AS rn FROM page_texts)
SELECT doc_name, left(string_agg(text, chr(10) || chr(10) ORDER BY page_idx), 4000) AS text FROM f WHERE rn <= 3 GROUP BY doc_name""")
def first_pages_text(spark, sf):
    return ingest.first_pages_text(I.page_texts(spark, sf))


@query("doc_id_from_text", "SELECT doc_id, left(md5(left(text, 1000)), 12) AS short_id FROM documents")
def doc_id_from_text(spark, sf):
    return I.text_table(spark, sf, "documents").select("doc_id", T.doc_id_from_text("text").alias("short_id"))


CELLS = [(0, 0), (0, 1), (1, 1), (1, 1), (5, 0)]


@query("table_cells_to_html", """
SELECT doc_id, '<table>' || chr(10) || '<tr><td>' || lang || '</td><td>' || source || '</td></tr>' || chr(10) ||
 CASE WHEN doc_id % 2 = 0 THEN '<tr><td></td><td>' || n_chars || '</td></tr>' || chr(10) ELSE '' END || '</table>' AS html FROM documents""")
def table_cells_to_html(spark, sf):
    d = I.text_table(spark, sf, "documents")
    values = [F.col("lang"), F.col("source"), F.lit("old"), F.col("n_chars").cast("string"), F.lit("outside")]
    cells = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), v.alias("text")) for (r, c), v in zip(CELLS, values)])
    rows = F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1)
    return d.select("doc_id", T.table_cells_to_html(cells, rows, F.lit(2)).alias("html"))


@query("wiki_links", "WITH " + I.NOTES + " SELECT id, count(*) AS links FROM note_links GROUP BY id")
def wiki_links(spark, sf):
    return lookups.note_links(I.notes(spark, sf)).groupBy("id").agg(F.count(F.lit(1)).alias("links"))


# ---- rule classification ------------------------------------------------------------------

def _rule_query(name, column, sql, spark_expr):
    @query(name, LI + f" SELECT {KEY}, {sql} AS {column} FROM lines")
    def run(spark, sf):
        return _lines(spark, sf, **{column: spark_expr()})


_rule_query("classify_section", "section_tag", I.sql_rules(SENT_SQL, R.SECTION_RULES, "unknown", 300), lambda: R.classify_section(sentence()))
_rule_query("evidence_label", "label", I.sql_rules(SENT_SQL, R.EVIDENCE_LABEL_RULES, None), lambda: R.evidence_label(sentence()))
_rule_query("evidence_label_matrix", "label", I.sql_rules(SENT_SQL, R.MATRIX_LABEL_RULES, None), lambda: R.evidence_label_matrix(sentence()))
_rule_query("chunk_type", "chunk_type", I.sql_rules(SENT_SQL, R.CHUNK_TYPE_RULES, "other"), lambda: R.chunk_type(sentence()))
_rule_query("chunk_type_short", "chunk_type", I.sql_rules(SENT_SQL, R.CHUNK_TYPE_RULES_SHORT, "other"), lambda: R.chunk_type(sentence(), True))
_rule_query("evidence_level", "evidence_level",
            I.sql_rules(f"({SENT_SQL} || ' ' || source)", R.EVIDENCE_LEVEL_RULES, None) + "::BIGINT",
            lambda: R.evidence_level(sentence(), F.col("source")))
_rule_query("evidence_level_long", "evidence_level",
            I.sql_rules(f"({SENT_SQL} || ' ' || source)", R.EVIDENCE_LEVEL_RULES_LONG, None) + "::BIGINT",
            lambda: R.evidence_level(sentence(), F.col("source"), True))
_LEAD = f"({I.sql_count('lower(' + SENT_SQL + ')', R.SUPPORT_WORDS)} - {I.sql_count('lower(' + SENT_SQL + ')', R.AGAINST_WORDS)})"
_rule_query("detect_direction", "direction",
            f"CASE WHEN {_LEAD} > 1 THEN 'supportive' WHEN {_LEAD} < -1 THEN 'against' ELSE 'neutral' END", lambda: R.direction(sentence()))
_rule_query("segment_type", "segment_type",
            "CASE " + I.sql_rules(SENT_SQL, R.CHUNK_TYPE_RULES, "other") + " " + " ".join(
                f"WHEN '{k}' THEN '{v}'" for k, v in R.SEGMENT_TYPES.items()) + " ELSE 'other' END", lambda: R.segment_type(R.chunk_type(sentence())))
_rule_query("resolve_model_labels", "label",
            f"CASE WHEN line_no % 3 = 0 AND source = 'src1' THEN 'methods' WHEN line_no % 3 = 1 THEN 'safety' ELSE "
            f"{I.sql_rules(SENT_SQL, R.SECTION_RULES, 'unknown', 300)} END",
            lambda: R.resolve_label(F.when(F.col("line_no") % 3 == 0, F.when(F.col("source") == "src1", " Methods ").otherwise("nonsense"))
                            .when(F.col("line_no") % 3 == 1, "SAFETY"), R.classify_section(sentence())))


@query("detect_evidence_type", f"""
WITH t AS (SELECT doc_id, {I.sql_rules('(' + I.DOC_SENTENCE + ' || text)', R.EVIDENCE_TYPE_RULES, 'unknown', 2000)} AS type FROM documents)
SELECT doc_id, type, CASE type WHEN 'meta_analysis' THEN 1 WHEN 'rct' THEN 2 WHEN 'cohort_study' THEN 3 WHEN 'case_control' THEN 4
 WHEN 'case_report' THEN 5 WHEN 'expert_consensus' THEN 6 ELSE 7 END::BIGINT AS level FROM t""")
def detect_evidence_type(spark, sf):
    d = I.text_table(spark, sf, "documents")
    return d.select("doc_id", R.detect_evidence_type(F.concat(F.expr(I.DOC_SENTENCE), F.col("text"))).alias("e")).select("doc_id", "e.type", "e.level")


@query("entity_group", "WITH " + I.NODES + " SELECT grp, count(*) AS nodes FROM nodes GROUP BY grp")
def entity_group(spark, sf):
    return I.nodes(spark, sf).groupBy("grp").agg(F.count(F.lit(1)).alias("nodes"))


@query("parse_evidence_level", f"""
WITH s AS (SELECT doc_id, lower(replace({I.STUDY_TYPE}, '-', '_')) AS t FROM documents), l AS (
SELECT doc_id, CASE {' '.join(f"WHEN t = '{k}' THEN {v}" for k, v in R.LEVEL_BY_NAME.items())} ELSE 7 END::BIGINT AS level FROM s)
SELECT doc_id, level, CASE level WHEN 1 THEN 'META_ANALYSIS' WHEN 2 THEN 'RCT' WHEN 3 THEN 'COHORT' WHEN 4 THEN 'CASE_CONTROL'
 WHEN 5 THEN 'CASE_REPORT' WHEN 6 THEN 'EXPERT_CONSENSUS' ELSE 'UNKNOWN' END AS name,
 CASE level WHEN 1 THEN 'Meta分析/系统综述' WHEN 2 THEN 'RCT' WHEN 3 THEN '队列研究' WHEN 4 THEN '病例对照' WHEN 5 THEN '病例报告'
 WHEN 6 THEN '专家共识' ELSE '未知证据' END AS label,
 CASE level WHEN 1 THEN '[Meta分析/系统综述] 最高等级证据' WHEN 2 THEN '[随机对照试验(RCT)] 高等级证据' WHEN 3 THEN '[队列研究] 中等证据'
 WHEN 4 THEN '[病例对照研究] 中低等证据' WHEN 5 THEN '[病例报告/病例系列] 低等级证据' WHEN 6 THEN '[专家共识/指南] 权威共识' ELSE '[证据等级待定]' END AS prefix
FROM l""")
def parse_evidence_level(spark, sf):
    d = I.text_table(spark, sf, "documents").select("doc_id", R.parse_evidence_level(F.expr(I.STUDY_TYPE)).alias("level"))
    return d.select("*", R.level_name("level").alias("name"), R.level_label("level").alias("label"), R.level_prefix("level").alias("prefix"))


TOOL = I.pick("turn", ["search_rag", "deep_retrieve", "list_docs"])
ANSWER = "(CASE WHEN turn % 3 = 0 THEN '[1] ' ELSE '' END || CASE WHEN conv_id % 5 = 0 THEN repeat('可能', 6) ELSE '' END || text || CASE WHEN conv_id % 11 = 0 THEN ' tool_call' ELSE '' END)"
PREVIEW = "(CASE WHEN (conv_id + turn) % 4 = 0 THEN '未找到' ELSE 'ok' END)"


@query("critique_answer", f"""
WITH b AS (SELECT conv_id, turn, text AS query, {ANSWER} AS answer, turn % 4 AS n, {TOOL} AS tool, {PREVIEW} AS preview FROM conversations),
f AS (SELECT *, {I.sql_any('answer', R.SOURCE_MARKS)} AS has_source,
  n > 0 AND tool IN ('search_rag', 'deep_retrieve') AS searched, preview = '未找到' AS emp,
  (length(answer) - length(replace(answer, '可能', ''))) / 2 + (length(answer) - length(replace(answer, '不确定', ''))) / 3
   + (length(answer) - length(replace(answer, '暂无', ''))) / 2 > 5 AS hedging,
  length(answer) < 80 AND query <> '' AS short, contains(answer, '<｜') OR contains(answer, 'tool_call') AS artefact FROM b),
g AS (SELECT *, CASE WHEN NOT searched OR (searched AND emp) OR artefact THEN 'low'
  WHEN (NOT has_source AND n > 0) OR hedging OR short THEN 'medium' ELSE 'high' END AS confidence FROM f)
SELECT conv_id, turn, confidence, array_to_string(list_filter([
  CASE WHEN NOT has_source AND n > 0 THEN '{R.ISSUE_NO_SOURCE}' END, CASE WHEN NOT searched THEN '{R.ISSUE_NO_SEARCH}' END,
  CASE WHEN searched AND emp THEN '{R.ISSUE_EMPTY_SEARCH}' END, CASE WHEN hedging THEN '{R.ISSUE_HEDGING}' END,
  CASE WHEN short THEN '{R.ISSUE_SHORT}' END, CASE WHEN artefact THEN '{R.ISSUE_TOOL_TEXT}' END], lambda x: x IS NOT NULL), '|') AS issues,
  CASE WHEN confidence = 'low' AND query <> '' THEN array_to_string(list_filter(string_split_regex(replace(replace(query, '？', ''), '?', ''), '\\s+'),
   lambda w: w <> '')[1:5], ' ') ELSE query END AS refined_query FROM g""")
def critique_answer(spark, sf):
    c = I.table(spark, sf, "conversations")
    step = F.struct(F.expr(TOOL).alias("tool"), F.expr(PREVIEW).alias("result_preview"))
    steps = F.array_repeat(step, (F.col("turn") % 4).cast("int"))
    r = c.select("conv_id", "turn", R.critique(F.col("text"), F.expr(ANSWER), steps).alias("r"))
    return r.select("conv_id", "turn", "r.*")


EXPECTED_SQL = "[left(lang, 1), 'hr', 'nowhere', source]"
SCORED = f"({I.DOC_SENTENCE} || CASE WHEN doc_id % 3 = 0 THEN '来源 [p.3] ' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN '绝对 ' ELSE '' END || text)"


@query("score_answer", f"""
WITH a AS (SELECT doc_id, {SCORED} AS x, {EXPECTED_SQL} AS ex FROM documents),
s AS (SELECT doc_id, length(x) < 20 AS bad,
  least(10, CASE WHEN length(x) > 80 THEN 3 ELSE 0 END + CASE WHEN length(x) > 200 THEN 2 ELSE 0 END +
    CASE WHEN {I.sql_any('x', R.RUBRIC_STRUCTURE)} THEN 3 ELSE 0 END + 2) AS relevance,
  least(10, round_even(len(list_filter(ex, lambda e: contains(lower(x), lower(e)))) / 4 * 10, 0)::BIGINT) AS completeness,
  least(10, {I.sql_count('x', R.RUBRIC_SOURCING)} * 2 + 2) AS sourcing, least(10, {I.sql_count('x', R.RUBRIC_DATA)} * 2 + 1) AS specificity,
  least(10, CASE WHEN {I.sql_any('x', R.RUBRIC_OVERCONFIDENT)} THEN greatest(0, CASE WHEN {I.sql_any('x', R.RUBRIC_HEDGED)} THEN 7 ELSE 4 END - 4)
    ELSE CASE WHEN {I.sql_any('x', R.RUBRIC_HEDGED)} THEN 7 ELSE 4 END END + 2) AS safety FROM a),
z AS (SELECT doc_id, CASE WHEN bad THEN 0 ELSE relevance END::BIGINT AS relevance, CASE WHEN bad THEN 0 ELSE completeness END::BIGINT AS completeness,
  CASE WHEN bad THEN 0 ELSE sourcing END::BIGINT AS sourcing, CASE WHEN bad THEN 0 ELSE specificity END::BIGINT AS specificity,
  CASE WHEN bad THEN 0 ELSE safety END::BIGINT AS safety FROM s)
SELECT *, round((relevance + completeness + sourcing + specificity + safety) / 5.0::DOUBLE, 6) AS total FROM z""")
def score_answer(spark, sf):
    d = I.text_table(spark, sf, "documents")
    expected = F.array(F.left("lang", F.lit(1)), F.lit("hr"), F.lit("nowhere"), F.col("source"))
    return d.select("doc_id", R.score_answer(F.expr(SCORED), expected).alias("s")).select("doc_id", "s.*")


@query("classify_uploads", "WITH " + I.TASKS + """,
done AS (SELECT * FROM tasks WHERE status = 'done'),
pairs AS (SELECT t.task_uuid, count(d.task_uuid) AS n_name, arg_min(d.file_md5, (d.created_at, d.task_uuid)) AS first_md5
  FROM tasks t LEFT JOIN done d ON d.filename = t.filename AND d.task_uuid <> t.task_uuid GROUP BY t.task_uuid),
same AS (SELECT t.task_uuid, count(d.task_uuid) AS n_md5 FROM tasks t LEFT JOIN done d ON d.file_md5 = t.file_md5 AND d.task_uuid <> t.task_uuid GROUP BY t.task_uuid)
SELECT t.task_uuid, CASE
  WHEN is_update OR (chunks_added > 0 AND n_name > 0 AND (n_md5 = 0 OR t.file_md5 <> first_md5)) THEN '版本更新'
  WHEN status = 'failed' AND (n_md5 > 0 OR (n_name > 0 AND first_md5 = t.file_md5)) THEN '重复入梦'
  WHEN status = 'failed' AND chunks_added = 0 THEN '未竟之章' WHEN n_md5 > 0 THEN '似曾相识'
  WHEN chunks_added > 0 AND status = 'done' THEN '新篇入阁' WHEN chunks_added > 0 THEN '部分收录' ELSE '待定之章' END AS outcome
FROM tasks t JOIN pairs USING (task_uuid) JOIN same USING (task_uuid)""")
def classify_uploads(spark, sf):
    return lookups.classify_uploads(I.tasks(spark, sf)).select("task_uuid", "outcome")
