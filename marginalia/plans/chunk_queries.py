"""Queries over chunking, order-dependent and incremental operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import rules as R
from marginalia.operators import chunking as C
from marginalia.operators import incremental as N
from marginalia.operators import ingest
from marginalia.plans import inputs as I
from marginalia.plans.registry import query
from marginalia.session import ensure_checkpoint_dir, written

# ---- paragraph packing --------------------------------------------------------------------
# a page for the splitter: every line of a document is a paragraph


def _doc_pages(spark, sf):
    b = I.text_table(spark, sf, "documents")
    text = F.concat(F.expr(I.DOC_SENTENCE), F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return b.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_name"), F.lit(0).alias("page_idx"), text.alias("text"))


def _sql_pack(parts: str, must_break: str, joiner: str) -> str:
    """The packing fold as list_reduce over one-element states."""
    p, n = "x.open", "length(x.open)"
    flush = f"(a.len > 250 AND ({must_break} OR a.len + {n} > 1200))"
    step = (f"struct_pack(done := CASE WHEN {flush} THEN list_append(a.done, a.open) ELSE a.done END, "
            f"open := CASE WHEN {flush} OR a.open IS NULL THEN {p} ELSE a.open || {joiner} || {p} END, "
            f"len := CASE WHEN {flush} THEN {n} ELSE a.len + {n} END)")
    init = "struct_pack(done := []::VARCHAR[], open := NULL::VARCHAR, len := 0::BIGINT)"
    elems = f"list_transform({parts}, lambda e: struct_pack(done := []::VARCHAR[], open := e, len := 0::BIGINT))"
    return f"list_reduce({elems}, lambda a, x: {step}, {init})"


_OPENS = ("(regexp_matches(x.open, '(?i)^(METHODS?|RESULTS?|INTRODUCTION|DISCUSSION|CONCLUSIONS?|References?|Abbreviations?\\s*(and\\s+Acronyms)?|"
          "Study\\s+(design|population)|Statistical\\s+analysis|Table\\s+\\d+|Figure\\s+\\d+|WORKS\\s+IN\\s+PROGRESS)') OR "
          "regexp_matches(x.open, '^.+(n\\s*=|IQR|\\[\\d|\\(\\d+%\\)|\\d+\\s+vs\\s+\\d+)'))")

SPLIT_SQL = f"""
WITH pages AS (SELECT 'doc' || doc_id AS doc_name, {I.DOC_SENTENCE} || replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
paras AS (SELECT doc_name, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda p: {I.sql_strip('p')}), lambda p: p <> '') AS ps FROM pages),
packed AS (SELECT doc_name, {_sql_pack('ps', _OPENS, "chr(10) || chr(10)")} AS r FROM paras WHERE len(ps) > 0),
big AS (SELECT doc_name, unnest(list_append(r.done, r.open)) AS c, generate_subscripts(list_append(r.done, r.open), 1) AS i FROM packed),
sub AS (SELECT doc_name, i, c, CASE WHEN length(c) > 1200 THEN {_sql_pack("string_split(regexp_replace(c, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))", "false", "' '")} END AS r FROM big),
pieces AS (SELECT doc_name, i, unnest(CASE WHEN r IS NULL THEN [c] ELSE list_append(r.done, r.open) END) AS piece,
   generate_subscripts(CASE WHEN r IS NULL THEN [c] ELSE list_append(r.done, r.open) END, 1) AS j,
   r IS NULL AND length(c) < 250 AND i > 1 AS glue FROM sub),
heads AS (SELECT *, sum(CASE WHEN glue THEN 0 ELSE 1 END) OVER (PARTITION BY doc_name ORDER BY i, j) AS seq FROM pieces),
out AS (SELECT doc_name, seq - 1 AS seq, string_agg(piece, chr(10) || chr(10) ORDER BY i, j) AS text FROM heads GROUP BY doc_name, seq)
SELECT doc_name, seq::BIGINT AS seq, text FROM out WHERE NOT {I.sql_loop('text')}"""


@query("split_paragraphs", SPLIT_SQL)
def split_paragraphs(spark, sf):
    return C.page_chunks(_doc_pages(spark, sf)).select("doc_name", "seq", "text")


@query("fixed_size_chunks", """
SELECT doc_id, seq, substring(text, seq * 512 + 1, 512) AS piece
FROM (SELECT doc_id, text, unnest(range(ceil(length(text) / 512.0)::BIGINT)) AS seq FROM documents WHERE text <> '')""")
def fixed_size_chunks(spark, sf):
    return C.fixed_size_chunks(I.text_table(spark, sf, "documents")).select("doc_id", "seq", "piece")


@query("merge_text_by_page", "WITH " + I.PAGES + " SELECT doc_name, page_idx, text FROM page_texts")
def merge_text_by_page(spark, sf):
    return I.page_texts(spark, sf)


def _paragraphs(spark, sf):
    return I.lines(spark, sf).select("doc_name", F.col("line_no").alias("para_idx"), F.expr(I.PAGE_OF_LINE).alias("page_idx"),
                                     F.concat(F.expr(I.LINE_SENTENCE), F.col("line")).alias("text"))


@query("section_islands", "WITH " + I.LINES + f""",
p AS (SELECT doc_name, line_no AS idx, {I.PAGE_OF_LINE} AS page, {I.LINE_SENTENCE} || line AS text FROM lines),
t AS (SELECT *, row_number() OVER w AS rn, {I.sql_rules('text', R.SECTION_RULES, 'unknown', 300)} AS raw_tag FROM p
  WHERE length({I.sql_strip('text')}) > 50 WINDOW w AS (PARTITION BY doc_name ORDER BY idx)),
u AS (SELECT *, CASE WHEN rn = 1 THEN 'background' ELSE raw_tag END AS tag FROM t),
v AS (SELECT *, CASE WHEN tag IS DISTINCT FROM lag(tag) OVER (PARTITION BY doc_name ORDER BY idx) THEN 1 ELSE 0 END AS brk FROM u),
x AS (SELECT *, sum(brk) OVER (PARTITION BY doc_name ORDER BY idx) AS seq FROM v),
s AS (SELECT doc_name, seq, any_value(tag) AS section_tag, count(*) AS paragraphs, arg_min(page, idx) AS first_page,
  {I.sql_strip("string_agg(text, chr(10) || chr(10) ORDER BY idx)")} AS content FROM x GROUP BY doc_name, seq),
m AS (SELECT doc_name, max(page) AS last_page FROM p GROUP BY doc_name)
SELECT s.doc_name, (seq - 1)::BIGINT AS seq, section_tag, lag(section_tag) OVER (PARTITION BY s.doc_name ORDER BY seq) AS parent_section,
  coalesce(lead(first_page) OVER (PARTITION BY s.doc_name ORDER BY seq), last_page) AS page_idx, paragraphs, content
FROM s JOIN m USING (doc_name)""")
def section_islands(spark, sf):
    return C.section_islands(_paragraphs(spark, sf))


MERGED = I.CHUNKS + """,
mb AS (SELECT *, CASE WHEN section_tag IS NOT DISTINCT FROM lag(section_tag) OVER w AND page_idx IS NOT DISTINCT FROM lag(page_idx) OVER w
   AND lag(chunk_idx) OVER w IS NOT NULL THEN 0 ELSE 1 END AS brk FROM chunks WINDOW w AS (PARTITION BY doc_name ORDER BY chunk_idx)),
mr AS (SELECT *, sum(brk) OVER (PARTITION BY doc_name ORDER BY chunk_idx) AS run FROM mb),
merged AS (SELECT doc_name, (run - 1)::BIGINT AS chunk_idx, any_value(section_tag) AS section_tag, any_value(page_idx) AS page_start,
   any_value(page_idx) AS page_end, count(*) AS merged, string_agg(text, chr(10) ORDER BY chunk_idx) AS text,
   CASE WHEN count(*) > 1 THEN doc_name || ' [p.' || any_value(page_idx) || '-' || any_value(page_idx) || ']'
   ELSE any_value(source) END AS source FROM mr GROUP BY doc_name, run)"""


def merged(spark, sf):
    return C.merge_adjacent(I.chunks(spark, sf))


@query("merge_adjacent", "WITH " + MERGED + " SELECT * FROM merged")
def merge_adjacent(spark, sf):
    return merged(spark, sf)


@query("merge_candidates", "WITH " + MERGED + """,
n AS (SELECT *, lag(chunk_idx) OVER w AS pair, lag(section_tag) OVER w AS tag_a, lag(page_end) OVER w AS page_a, lag(text) OVER w AS text_a
  FROM merged WINDOW w AS (PARTITION BY doc_name ORDER BY chunk_idx)),
c AS (SELECT *, CASE WHEN tag_a IS NOT DISTINCT FROM section_tag AND page_a <> page_start THEN 'cross_page'
  WHEN tag_a IS DISTINCT FROM section_tag AND page_a = page_start THEN 'cross_tag' END AS reason FROM n WHERE pair IS NOT NULL)
SELECT doc_name, pair, reason, tag_a, section_tag AS tag_b, right(text_a, 150) AS tail, left(text, 150) AS head FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_name ORDER BY chunk_idx) AS rn FROM c WHERE reason IS NOT NULL) WHERE rn <= 15""")
def merge_candidates(spark, sf):
    return C.merge_candidates(merged(spark, sf))


DECIDE = "length(text) % 3 > 0"
CONFIDENCE = "(CASE WHEN length(doc_name) % 5 = 0 THEN 'low' WHEN length(doc_name) % 5 = 1 THEN 'medium' ELSE 'high' END)"


@query("apply_merge_decisions", "WITH RECURSIVE " + MERGED + f""",
d AS (SELECT *, ({DECIDE}) AND {CONFIDENCE} <> 'low' AND lead(chunk_idx) OVER (PARTITION BY doc_name ORDER BY chunk_idx) IS NOT NULL AS take FROM merged),
walk AS (SELECT doc_name, chunk_idx, take, chunk_idx AS head, take AS absorbs FROM d WHERE chunk_idx = 0
  UNION ALL SELECT d.doc_name, d.chunk_idx, d.take, CASE WHEN w.absorbs THEN w.head ELSE d.chunk_idx END, NOT w.absorbs AND d.take
  FROM walk w JOIN d ON d.doc_name = w.doc_name AND d.chunk_idx = w.chunk_idx + 1),
g AS (SELECT doc_name, head, first(section_tag ORDER BY chunk_idx) AS section_tag, arg_min(page_start, chunk_idx) AS page_start,
  arg_max(page_end, chunk_idx) AS page_end, string_agg(text, chr(10) ORDER BY chunk_idx) AS text, count(*) > 1 AS model_merged,
  arg_min(source, chunk_idx) AS src FROM walk JOIN merged USING (doc_name, chunk_idx) GROUP BY doc_name, head)
SELECT doc_name, row_number() OVER (PARTITION BY doc_name ORDER BY head) - 1 AS chunk_idx, section_tag, page_start, page_end, text, model_merged,
  CASE WHEN model_merged THEN split_part(src, ' [p.', 1) || ' [p.' || page_start || '-' || page_end || ']' ELSE src END AS source FROM g""")
def apply_merge_decisions(spark, sf):
    m = written(merged(spark, sf))  # read three times
    last = m.groupBy("doc_name").agg(F.max("chunk_idx").alias("last"))
    decisions = m.join(last, "doc_name").where(F.col("chunk_idx") < F.col("last")).select(
        "doc_name", F.col("chunk_idx").alias("pair"), F.expr(DECIDE).alias("merge"), F.expr(CONFIDENCE).alias("confidence"))
    return C.apply_merge_decisions(m, decisions)


def merged_sql(rows: str) -> str:
    """Elements of ``rows`` merged left to right, document by document."""
    return f""",
n AS (SELECT *, lead(type) OVER w AS nt, lead(text) OVER w AS nx, lead(page_idx) OVER w AS np, lead(table_body) OVER w AS nb
  FROM {rows} WINDOW w AS (PARTITION BY doc_name ORDER BY item_idx)),
k AS (SELECT *, CASE WHEN type = 'text' AND nt = 'table' AND length(text) < 300 THEN 'table'
  WHEN type = 'text' AND nt = 'text' AND page_idx = np AND length(text) < 80 THEN 'text' END AS kind FROM n),
walk AS (SELECT doc_name, item_idx, false AS gone, kind IS NOT NULL AS absorbs FROM k WHERE item_idx = 0
  UNION ALL SELECT k.doc_name, k.item_idx, w.absorbs, NOT w.absorbs AND k.kind IS NOT NULL
  FROM walk w JOIN k ON k.doc_name = w.doc_name AND k.item_idx = w.item_idx + 1),
joined AS (SELECT doc_name, item_idx, coalesce(CASE WHEN kind = 'table' THEN 'table' END, type) AS type, page_idx,
  CASE kind WHEN 'table' THEN '[表] ' || text || chr(10) || nb WHEN 'text' THEN text || ' ' || nx ELSE text END AS text,
  CASE WHEN kind = 'table' THEN text END AS table_caption,
  CASE WHEN kind = 'table' THEN nb WHEN type = 'table' THEN table_body END AS table_body, kind IS NOT NULL AS merged
FROM k JOIN walk USING (doc_name, item_idx) WHERE NOT gone)"""


@query("merge_elements", "WITH RECURSIVE " + I.ITEMS + merged_sql("items") + " SELECT * FROM joined")
def merge_elements(spark, sf):
    return C.merge_elements(I.items(spark, sf))


# one line in seven holds artefacts; a model wrote out every other item and failed at some
SPOILED = "(CASE WHEN (doc_id + item_idx) % 7 = 2 THEN 'p/zero.pl.tnum/one.case ' ELSE '' END || text)"
MENDED = "(CASE WHEN (doc_id + item_idx) % 7 = 2 THEN 'p01 ' ELSE '' END || text)"
MADE = "(CASE WHEN item_idx % 6 <> 4 THEN ' written out: ' || doc_name || ' ' || item_idx || ' ' END)"


@query("postprocess_items", "WITH RECURSIVE " + I.ITEMS + f""",
mended AS (SELECT * REPLACE (CASE WHEN type = 'text' THEN {MENDED} ELSE {SPOILED} END AS text) FROM items)""" + merged_sql("mended") + f""",
m AS (SELECT *, {MADE} AS made, item_idx % 2 = 0 AS tried, type = 'table' AND length(coalesce(table_body, '')) >= 50 AS is_table, type = 'image' AS is_figure FROM joined),
s AS (SELECT doc_name, item_idx, type, page_idx, merged, tried AND made IS NOT NULL AND (is_table OR is_figure) AS serialized,
  CASE WHEN NOT tried THEN text WHEN is_table AND made IS NOT NULL THEN '[表格序列化] ' || trim(made)
    WHEN is_table THEN '[表] ' || coalesce(table_caption, '') || chr(10) || left(table_body, 500)
    WHEN is_figure AND made IS NOT NULL THEN '[图表序列化] ' || trim(made) ELSE text END AS text FROM m)
SELECT *, (SELECT count(*) FROM items WHERE type = 'text' AND (doc_id + item_idx) % 7 = 2) AS all_cleaned,
  (SELECT count(*) FROM s WHERE merged) AS all_merged, (SELECT count(*) FROM s WHERE serialized) AS all_serialized FROM s""")
def postprocess_items(spark, sf):
    """Items and the counts of what was done to them, from one pass: the items are written, the counts observed."""
    items = I.items(spark, sf).withColumn("text", F.expr(SPOILED)).drop("table_caption")
    made = I.items(spark, sf).where("item_idx % 2 = 0").select("doc_name", "item_idx", F.expr(MADE).alias("text"))
    rows, counts = C.postprocess_items(items, made)
    rows = written(rows.select("doc_name", "item_idx", "type", "page_idx", "text", "merged", "serialized"))
    return rows.withColumns({f"all_{k}": F.lit(n).cast("bigint") for k, n in counts().items()})


def sql_figure(x: str) -> str:
    ls = f"list_transform(string_split({x}, chr(10)), lambda q: {I.sql_strip('q')})"
    pos = (f"list_position(list_transform({ls}, lambda q: contains(lower(q), 'figure ') OR contains(lower(q), 'fig. ') OR "
           f"contains(lower(q), 'survival curve') OR contains(lower(q), 'time course')), true)")
    return f"(CASE WHEN {pos} > 0 THEN array_to_string(list_filter(({ls})[{pos}:{pos} + 3], lambda q: q <> ''), ' | ') END)"


@query("figure_description", "WITH " + I.PAGES + f"""
SELECT doc_name, page_idx, {sql_figure('text')} AS figure FROM page_texts""")
def figure_description(spark, sf):
    from marginalia.functions.text import figure_description as describe
    return I.page_texts(spark, sf).select("doc_name", "page_idx", describe("text").alias("figure"))


@query("attach_figure_text", "WITH " + I.CHUNKS + I.PAGES[len(I.ITEMS):] + f""",
fig AS (SELECT doc_name, page_idx, {sql_figure('text')} AS line FROM page_texts),
hint AS (SELECT doc_name, page_idx, left(arg_min(text, chunk_idx), 300) AS t FROM chunks WHERE contains(lower(text), 'figure') OR
  contains(lower(text), 'survival') OR contains(lower(text), 'curve') OR contains(lower(text), 'chart') GROUP BY doc_name, page_idx),
img AS (SELECT doc_name, item_idx, page_idx, cap FROM items WHERE type = 'image')
SELECT img.doc_name, img.item_idx, img.page_idx, {I.sql_strip("coalesce(a.line, b.line, c.line, hint.t, CASE WHEN cap <> '' THEN '[图片] ' || cap END, '[图片 p' || img.page_idx || ']')")} AS text
FROM img LEFT JOIN fig a ON a.doc_name = img.doc_name AND a.page_idx = img.page_idx AND a.line IS NOT NULL
LEFT JOIN fig b ON b.doc_name = img.doc_name AND b.page_idx = img.page_idx + 1 AND b.line IS NOT NULL
LEFT JOIN fig c ON c.doc_name = img.doc_name AND c.page_idx = img.page_idx - 1 AND c.line IS NOT NULL
LEFT JOIN hint ON hint.doc_name = img.doc_name AND hint.page_idx = img.page_idx""")
def attach_figure_text(spark, sf):
    images = I.items(spark, sf).where(F.col("type") == "image").select(
        "doc_name", "item_idx", "page_idx", F.array_join(F.coalesce("image_caption", F.array().cast("array<string>")), " ").alias("caption"))
    return C.attach_figure_text(images, I.page_texts(spark, sf), I.chunks(spark, sf)).select("doc_name", "item_idx", "page_idx", "text")


@query("to_enhanced_items", "WITH " + I.STUDIES + """
SELECT 'doc' || doc_id AS doc_name, (-1)::BIGINT AS seq, 'pico_framework' AS section_tag, 0::BIGINT AS page_idx, '### PICO框架' || chr(10) ||
  CASE WHEN population <> '' THEN '- **POPULATION**: ' || population || chr(10) ELSE '' END ||
  CASE WHEN intervention <> '' THEN '- **INTERVENTION**: ' || intervention || chr(10) ELSE '' END ||
  CASE WHEN comparison <> '' THEN '- **COMPARISON**: ' || comparison || chr(10) ELSE '' END || '- **OUTCOME**: ' || outcome || chr(10) AS text FROM studies
UNION ALL SELECT 'doc' || doc_id, 0, 'results', doc_id % 7, text FROM documents""")
def to_enhanced_items(spark, sf):
    s = I.studies(spark, sf)
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_name")
    dims = ["population", "intervention", "comparison", "outcome"]
    pico = s.select(name, F.array(*[F.struct(F.lit(d).alias("dim"), F.col("pico")[d].alias("value")) for d in dims],
                                  F.struct(F.lit("evidence_type").alias("dim"), F.col("evidence_type").alias("value"))).alias("parts"))
    sections = I.text_table(spark, sf, "documents").select(name, F.lit(0).cast("bigint").alias("seq"), F.lit("results").alias("section_tag"),
                                                      (F.col("doc_id") % 7).alias("page_idx"), F.col("text").alias("content"))
    return C.to_enhanced_items(sections, pico)


@query("inject_evidence_metadata", "WITH " + I.ITEMS + "," + I.STUDIES + """
SELECT i.doc_name, item_idx, CASE WHEN i.type = 'text' THEN s.evidence_type END AS evidence_type,
  CASE WHEN i.type = 'text' THEN s.title END AS doc_title FROM items i LEFT JOIN (SELECT * FROM studies WHERE has_effects) s ON s.doc_id = i.doc_id""")
def inject_evidence_metadata(spark, sf):
    s = I.studies(spark, sf).where(F.size("effects") > 0)
    e = s.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_name"), F.lit(2).alias("evidence_level"),
                 "evidence_type", F.col("title").alias("doc_title"))
    return C.inject_evidence_metadata(I.items(spark, sf), e).select("doc_name", "item_idx", "evidence_type", "doc_title")


def _typed_items(spark, sf):
    return I.items(spark, sf).withColumn("chunk_type", R.chunk_type("text")).withColumn("section_tag", F.lit("x")).withColumn(
        "evidence_level", R.evidence_level(F.col("text"), F.lit(""))).withColumn("one_liner", F.col("doc_name"))


@query("build_segments", "WITH " + I.ITEMS + f""", t AS (SELECT *, {I.sql_rules('text', R.CHUNK_TYPE_RULES, 'other')} AS ct,
  {I.sql_rules("(text || ' ')", R.EVIDENCE_LEVEL_RULES, None)} AS lv FROM items WHERE type = 'text' AND text <> '')
SELECT doc_name, row_number() OVER (PARTITION BY doc_name ORDER BY item_idx) AS sequence, text AS content, CASE ct
  {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in R.SEGMENT_TYPES.items())} ELSE 'other' END AS segment_type, 'x' AS section_title,
  page_idx + 1 AS page_number, 0.9::DOUBLE AS confidence, length(text) AS word_count, coalesce(lv, '') AS evidence_level FROM t""")
def build_segments(spark, sf):
    return C.build_segments(_typed_items(spark, sf))


@query("build_figures", "WITH " + I.ITEMS + """
SELECT doc_name, row_number() OVER (PARTITION BY doc_name ORDER BY item_idx) AS sequence, 'figure' AS figure_type, doc_name AS caption,
  text AS description, page_idx + 1 AS page_number, 0.85::DOUBLE AS confidence, '/data/img/' || doc_name || '_' || item_idx || '.png' AS img_path
FROM items WHERE type = 'image'""")
def build_figures(spark, sf):
    return C.build_figures(_typed_items(spark, sf))


@query("replace_children", """
SELECT l_orderkey AS article_id, l_linenumber::BIGINT AS sequence, l_shipdate AS at FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT o_orderkey, 1, o_orderdate FROM orders WHERE o_orderstatus = 'P'""")
def replace_children(spark, sf):
    old = I.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").cast("bigint").alias("sequence"),
                                               F.col("l_shipdate").alias("at"))
    new = I.table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").alias("article_id"), F.lit(1).cast("bigint").alias("sequence"), F.col("o_orderdate").alias("at"))
    return C.replace_children(old, new, "article_id")


# ---- incremental maintenance --------------------------------------------------------------
# the new version of a document changes some of its lines (those at positions divisible by 4); every third
# document loses its first item, every other third gets a new one in front, so positions shift both ways
NUMBER = "CAST(substring(doc_name, 4) AS BIGINT)"
SHIFT = f"(CASE {NUMBER} % 3 WHEN 1 THEN -1 WHEN 2 THEN 1 ELSE 0 END)"
CHANGED = "(CASE WHEN item_idx % 4 = 0 AND type = 'text' THEN text || ' Revised.' ELSE text END)"
def versions(stored: str = I.CHUNKS, only: str = "true") -> str:
    """Stored chunks and the new versions of the documents that ``only`` names, met by document and hash."""
    return stored + f""",
new_items AS (SELECT doc_name, item_idx + {SHIFT} AS item_idx, type, page_idx, cap, table_body, {CHANGED} AS text FROM items WHERE {only} AND item_idx + {SHIFT} >= 0
  UNION ALL SELECT DISTINCT doc_name, 0, 'text', 0, '', '', 'A new first paragraph of ' || doc_name || ' for this version.' FROM items WHERE {only} AND {NUMBER} % 3 = 2),
new_candidates AS (
  SELECT doc_name, item_idx AS chunk_idx, type, page_idx,
         CASE WHEN type = 'text' AND length({I.sql_strip('text')}) > 30 THEN {I.sql_strip('text')}
              WHEN type = 'image' AND length(cap) > 10 THEN '[图片] ' || cap
              WHEN type = 'table' AND {I.sql_strip('table_body')} <> '' AND length('[表格] ' || cap || chr(10) || table_body) > 30
              THEN '[表格] ' || cap || chr(10) || table_body END AS text FROM new_items),
new_hashed AS (SELECT *, md5(text) AS content_md5 FROM new_candidates WHERE text IS NOT NULL),
counted AS (SELECT doc_name, content_md5, sum(o)::BIGINT AS o, sum(n)::BIGINT AS n FROM (
  SELECT doc_name, content_md5, 1 AS o, 0 AS n FROM chunks UNION ALL SELECT doc_name, content_md5, 0, 1 FROM new_hashed) GROUP BY ALL),
status AS (SELECT doc_name, content_md5, (o > 0 AND n > 0)::BIGINT AS kept, o - (o > 0 AND n > 0)::BIGINT AS stale, (o = 0 AND n > 0)::BIGINT AS added FROM counted)"""


VERSIONS = versions()


def stored_chunks(spark, sf):
    """The chunk table as it lies in storage: written once, then read by the update."""
    ensure_checkpoint_dir(spark)
    return I.chunks(spark, sf).checkpoint()


def new_items(spark, sf):
    items = I.items(spark, sf)
    text = F.expr(CHANGED)
    first = items.where(F.expr(f"item_idx = 0 AND {NUMBER} % 3 = 2")).select("doc_name", F.lit(0).cast("bigint").alias("item_idx"))
    given = {"type": F.lit("text"), "page_idx": F.lit(0).cast("bigint"), "text": F.concat(
        F.lit("A new first paragraph of "), F.col("doc_name"), F.lit(" for this version."))}
    front = first.select("doc_name", "item_idx", *[
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in items.schema.fields if f.name not in ("doc_name", "item_idx")])
    moved = items.withColumn("text", text).withColumn("item_idx", F.expr(f"item_idx + {SHIFT}")).where("item_idx >= 0")
    return moved.unionByName(front)


@query("diff_document", "WITH " + VERSIONS + " SELECT * FROM status")
def diff_document(spark, sf):
    return N.diff_document(I.chunks(spark, sf), ingest.items_to_chunks(new_items(spark, sf)))


def upserted(met: str = VERSIONS) -> str:
    """What remains of the stored chunks, and the fresh ones."""
    return met + f""",
placed AS (SELECT doc_name, content_md5, min(chunk_idx) AS at FROM new_hashed GROUP BY ALL),
touched AS (SELECT DISTINCT doc_name FROM new_items),
remaining AS (SELECT c.doc_name, p.at AS chunk_idx, c.type, c.content_md5, c.section_tag FROM chunks c JOIN placed p USING (doc_name, content_md5)
  UNION ALL SELECT doc_name, chunk_idx, type, content_md5, section_tag FROM chunks WHERE doc_name NOT IN (SELECT doc_name FROM touched)),
fresh AS (SELECT * EXCLUDE (rn) FROM (SELECT h.*, row_number() OVER (PARTITION BY content_md5 ORDER BY doc_name, chunk_idx) AS rn
  FROM new_hashed h JOIN status s USING (doc_name, content_md5) WHERE added = 1 AND length(text) >= 30 AND {I.sql_noise('text')} <= 0.5
  AND NOT {I.sql_loop('text')} AND content_md5 NOT IN (SELECT content_md5 FROM remaining)) WHERE rn = 1)"""


UPSERTED = upserted()
STATE = f"""
SELECT doc_name, chunk_idx, type, content_md5, section_tag FROM remaining UNION ALL
SELECT doc_name, chunk_idx, type, content_md5, CASE WHEN type = 'text' THEN {I.sql_rules('text', R.SECTION_RULES, 'unknown', 300)} END FROM fresh"""


@query("upsert_document", "WITH " + UPSERTED + STATE)
def upsert_document(spark, sf):
    state, _ = N.upsert_documents(stored_chunks(spark, sf), new_items(spark, sf))
    return state.select("doc_name", "chunk_idx", "type", "content_md5", "section_tag")


@query("upsert_counts", "WITH " + UPSERTED + """, f AS (SELECT doc_name, count(*) AS added FROM fresh GROUP BY doc_name)
SELECT doc_name, sum(kept)::BIGINT AS kept, sum(stale)::BIGINT AS stale, coalesce(any_value(f.added), 0) AS added
FROM status LEFT JOIN f USING (doc_name) WHERE doc_name IN (SELECT doc_name FROM touched) GROUP BY doc_name""")
def upsert_counts(spark, sf):
    return N.upsert_documents(stored_chunks(spark, sf), new_items(spark, sf))[1]


@query("document_hash", "WITH " + I.ITEMS + """
SELECT doc_name, md5(string_agg(text, chr(10) ORDER BY item_idx)) AS doc_md5 FROM items GROUP BY doc_name""")
def document_hash(spark, sf):
    return N.document_hash(I.items(spark, sf))


@query("skip_known_documents", """
WITH h AS (SELECT 'doc' || doc_id AS doc_name, md5(text) AS doc_md5, lang FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_md5 ORDER BY doc_name) AS rn FROM h WHERE doc_md5 NOT IN (SELECT doc_md5 FROM h WHERE lang = 'fr'))
SELECT doc_name, doc_md5 FROM f WHERE rn = 1""")
def skip_known_documents(spark, sf):
    h = I.text_table(spark, sf, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_name"),
                                              F.md5("text").alias("doc_md5"), "lang")
    return N.skip_known_documents(h.select("doc_name", "doc_md5"), h.where(F.col("lang") == "fr"))


@query("keep_first_copy", "WITH " + I.CHUNKS + " SELECT doc_name, chunk_idx, content_md5 FROM chunks")
def keep_first_copy(spark, sf):
    return ingest.keep_first_copy(ingest.quality_gate(ingest.items_to_chunks(I.items(spark, sf)))).select("doc_name", "chunk_idx", "content_md5")


@query("assign_vector_ids", "WITH " + I.CHUNKS + """
SELECT doc_name, chunk_idx, (SELECT max(vec_id) + 1 FROM embeddings) + row_number() OVER (ORDER BY doc_name, chunk_idx) - 1 AS vec_id FROM chunks""")
def assign_vector_ids(spark, sf):
    next_id = N.next_vector_id(I.vectors(spark, sf)).scalar()
    return N.assign_vector_ids(I.chunks(spark, sf).select("doc_name", "chunk_idx"), next_id)


@query("remove_document", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def remove_document(spark, sf):
    gone = I.text_table(spark, sf, "documents").where(F.col("lang") == "de").select(F.col("doc_id").alias("vec_id"))
    return N.remove_documents(I.vectors(spark, sf).select("vec_id"), gone, "vec_id")


@query("drop_cross_engine_duplicates", """
WITH n AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'mineru_doc' || (doc_id // 3) ELSE 'doc' || doc_id END AS doc_name FROM documents)
SELECT doc_name FROM n WHERE NOT (starts_with(doc_name, 'mineru_') AND substring(doc_name, 8) IN (SELECT doc_name FROM n))""")
def drop_cross_engine_duplicates(spark, sf):
    i = F.col("doc_id")
    n = F.when(i % 3 == 0, F.concat(F.lit("mineru_doc"), F.floor(i / 3).cast("string"))).otherwise(F.concat(F.lit("doc"), i.cast("string")))
    return ingest.drop_cross_engine_duplicates(I.text_table(spark, sf, "documents").select(n.alias("doc_name")))


@query("enrich_items", "WITH " + I.CHUNKS + f"""
SELECT doc_name, chunk_idx, {I.sql_rules('text', R.CHUNK_TYPE_RULES, 'other')} AS chunk_type,
 {I.sql_rules("(text || ' ')", R.EVIDENCE_LEVEL_RULES, None)}::BIGINT AS evidence_level FROM chunks""")
def enrich_items(spark, sf):
    c = I.chunks(spark, sf).withColumn("doc_title", F.lit(""))
    return ingest.enrich_items(c).select("doc_name", "chunk_idx", "chunk_type", "evidence_level")
