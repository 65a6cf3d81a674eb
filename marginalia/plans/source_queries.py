"""Round trips: what a table holds is written in a source's format, bad records among it, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import model_map as MM
from marginalia.plans import inputs as I
from marginalia.plans.registry import query
from marginalia.plans.stream_queries import _scratch
from marginalia.sources import readers as R
from marginalia.sources import writers as W


def _text_files(df: DataFrame, folder: str) -> None:
    """Each row of ``value`` as a file of its own."""
    df.select("value").write.option("maxRecordsPerFile", 1).text(folder)


def _store(df: DataFrame, key: Column, body: Column, group: Column, folder: str) -> None:
    """Key-value stores, an object of objects per group; an unreadable store among them."""
    member = F.concat(F.to_json(F.struct(key.alias("k"))), F.lit(""))
    name = F.regexp_extract(member, r'^\{"k":(.*)\}$', 1)
    stores = df.select(group.alias("g"), F.concat(name, F.lit(":"), body).alias("m")).groupBy("g").agg(
        F.concat(F.lit("{"), F.array_join(F.collect_list("m"), ","), F.lit("}")).alias("value"))
    _text_files(stores.select("value").unionByName(stores.sparkSession.createDataFrame([("{broken",)], "value string")), folder)


@query("read_kv_entities", """
SELECT s_name AS name, (CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE s_nationkey END)::BIGINT AS count, (CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey END)::BIGINT AS create_time,
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'c' || s_suppkey || '|' || s_name END AS chunk_ids FROM supplier WHERE s_suppkey % 7 <> 0""")
def read_kv_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh member is no object, every third has no fields."""
    folder = _scratch(spark) + "/e"
    full = F.to_json(F.struct(F.col("s_nationkey").alias("count"), F.col("s_suppkey").alias("create_time"),
                              F.array(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")), "s_name").alias("chunk_ids")))
    body = F.when(F.col("s_suppkey") % 7 == 0, F.lit('"text"')).when(F.col("s_suppkey") % 3 == 0, F.lit("{}")).otherwise(full)
    _store(I.table(spark, sf, "supplier"), F.col("s_name"), body, F.col("s_suppkey") % 5, folder)
    return R.read_kv_entities(spark, folder)


@query("read_kv_relations", """
SELECT s_name AS source, n_name || '<SEP>' || s_nationkey AS target, (s_nationkey + 1)::BIGINT AS count, 0::BIGINT AS create_time, s_name AS chunk_ids
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 0""")
def read_kv_relations(spark, sf):
    """Every fourth key lacks the separator; ends carry blanks, and a second separator stays in the target."""
    folder = _scratch(spark) + "/r"
    s = I.table(spark, sf, "supplier").join(I.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.when(F.col("s_suppkey") % 4 == 0, F.col("s_name")).otherwise(
        F.concat("s_name", F.lit(" <SEP> "), "n_name", F.lit("<SEP>"), F.col("s_nationkey").cast("string")))
    body = F.to_json(F.struct((F.col("s_nationkey") + 1).alias("count"), F.array("s_name").alias("chunk_ids")))
    _store(s, key, body, F.col("s_suppkey") % 5, folder)
    return R.read_kv_relations(spark, folder)


@query("read_doc_status", "SELECT 'doc' || doc_id AS doc_key, lang AS status, n_chars AS content_length, source || '.pdf' AS file_path FROM documents")
def read_doc_status(spark, sf):
    folder = _scratch(spark) + "/d"
    body = F.to_json(F.struct(F.col("lang").alias("status"), F.col("n_chars").alias("content_length"), F.concat("source", F.lit(".pdf")).alias("file_path")))
    _store(I.table(spark, sf, "documents"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")), body, F.col("doc_id") % 11, folder)
    return R.read_doc_status(spark, folder).select("doc_key", "status", "content_length", "file_path")


@query("read_graphml", """
SELECT 'node' AS kind, n_name AS a, NULL AS b, n_name || '|' || n_regionkey AS value FROM nation
UNION ALL SELECT 'edge', n_name, r_name, (n_nationkey + 0.5)::VARCHAR FROM nation JOIN region ON n_regionkey = r_regionkey""")
def read_graphml(spark, sf):
    folder = _scratch(spark) + "/g"
    n = I.table(spark, sf, "nation").join(I.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    esc = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    keys = ('<graphml><key id="d0" for="node" attr.name="source_id" attr.type="string"/>'
            '<key id="d1" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">')
    node = F.format_string('<node id="%s">\n<data key="d0">%s&lt;SEP&gt;%s</data>\n</node>', esc("n_name"), esc("n_name"), F.col("n_regionkey"))
    edge = F.format_string('<edge source="%s" target="%s">\n<data key="d1">%s</data>\n</edge>', esc("n_name"), esc("r_name"),
                           (F.col("n_nationkey") + 0.5).cast("string"))
    # a file per region; the text format escapes nothing, so a document is one value
    _text_files(n.groupBy("r_name").agg(F.concat(F.lit(keys), F.array_join(F.collect_list(F.concat(node, F.lit("\n"), edge)), "\n"),
                                                 F.lit("</graph></graphml>")).alias("value")), folder)
    a, b = R.read_graphml(spark, folder)
    return a.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"),
                    F.array_join(R.multi_value("attributes", "source_id"), "|").alias("value")).unionByName(
        b.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("attributes")["weight"].alias("value")))


@query("audit_round_trip", """
SELECT left(event_type || '-' || event_id || '-0123456789', 12) AS uuid, 'f' || user_id || '.pdf' AS filename, 'mineru25pro' AS engine FROM events""")
def audit_round_trip(spark, sf):
    """Audit events appended as lines, garbage among them, read back with their fields; uuids are cut, the engine defaults."""
    folder = _scratch(spark) + "/log"
    e = I.table(spark, sf, "events").select(F.concat_ws("-", "event_type", F.col("event_id").cast("string"), F.lit("0123456789")).alias("uuid"),
                                            F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("filename"))
    W.append_audit(e, "parse_start", folder)
    spark.createDataFrame([("no json",), ('{"ts": "2024-01-01T00:00:00Z"}',)], "value string").write.mode("append").text(folder)
    return R.audit_fields(R.read_audit(spark, folder), "parse_start", "uuid string, filename string, engine string").drop("ts")


# ---- all audit events: a payload with every field any of them has -------------------------
_NUMBERS = ["size", "page", "chars", "duration_ms", "chunks", "hallucinated", "images", "vectors_before", "vectors_added", "vectors_after",
            "article_id", "segments", "figures", "entities", "relations", "nodes", "edges", "step", "steps", "citations", "status", "pid"]
_KINDS = list(W.AUDIT_EVENTS)
_FIELDS = list(dict.fromkeys(f for fields in W.AUDIT_EVENTS.values() for f in fields))
_LONG = "repeat(event_type || '-' || event_id || ' ', 60)"


def _field_sql(field: str) -> str:
    """The value of a field, as SQL of both sides where they agree."""
    if field in _NUMBERS:
        return f"(event_id % {89 + len(field)})"
    return {"elapsed": "(CAST(event_id % 50 AS DOUBLE) + 0.5)", "success": "(event_id % 2 = 0)", "uuid": "md5(CAST(event_id AS VARCHAR(20)))"}.get(field, _LONG)


def _line_sql(kind: str) -> str:
    parts = [f"'ts', strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), 'type', '{kind}'"]
    for f in W.AUDIT_EVENTS[kind]:
        cut = W._cut(kind, f)
        value = {"pico_types": "json_object('P', event_id, 'list', json_array(1, NULL))"}.get(f, f"left({_field_sql(f)}, {cut})" if cut else _field_sql(f))
        if (default := W.AUDIT_DEFAULTS.get((kind, f))) is not None:  # every other payload lacks what has a default
            value = f"CASE WHEN event_id % 2 = 1 THEN '{default}'::JSON ELSE to_json({value}) END"
        parts.append(f"'{f}', {value}")
    return f"json_object({', '.join(parts)})::VARCHAR"


@query("audit_all_events", "SELECT event_id, CASE event_id % 25 " + " ".join(f"WHEN {i} THEN {_line_sql(k)}" for i, k in enumerate(_KINDS)) + """ END AS value
FROM events""")
def audit_all_events(spark, sf):
    """All kinds of events through one projection; payloads carry fields of other kinds too, which stay out."""
    e = I.spread(I.table(spark, sf, "events"))  # a payload is hundreds of times its event
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("event_id") % 25).cast("int"))

    def value(f: str) -> Column:
        if f == "pico_types":
            return F.struct(F.col("event_id").alias("P"), F.expr("array(1, CAST(NULL AS INT))").alias("list"))
        lacking = [k for k, g in W.AUDIT_DEFAULTS if g == f]
        return F.when((F.col("event_id") % 2 == 0) | ~kind.isin(lacking), F.expr(_field_sql(f))) if lacking else F.expr(_field_sql(f))

    given = [value(f).alias(f) for f in _FIELDS]
    log = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"), F.to_json(F.struct(*given)).alias("payload"))
    return W.audit_lines(log.unionByName(log.withColumn("type", F.lit("not an event"))))


@query("read_table", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def read_table(spark, sf):
    return R.read_table(spark, "nation", sf).select("n_nationkey", "n_name")


def _listed(spark, sf, value: Column) -> DataFrame:
    """``(file_name, value)`` per document, every tenth file unreadable, written and read as a table."""
    folder = _scratch(spark) + "/files"
    d = I.table(spark, sf, "documents")
    whole = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("["), F.left("text", F.lit(20)))).otherwise(value)
    d.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), whole.alias("value")).write.parquet(folder)
    return spark.read.parquet(folder)


@query("read_pages", """
SELECT 'doc' || doc_id AS doc_name, i - 1 AS page_idx, string_split(text, chr(10))[i] AS text FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i)
WHERE doc_id % 10 <> 0""")
def read_pages(spark, sf):
    files = _listed(spark, sf, F.to_json(F.split("text", "\n"))).select(F.concat("name", F.lit("_pages.json")).alias("file_name"), "value")
    return R.parse_pages(R.split_corrupt(files)[0])


@query("read_content_lists", """
SELECT 'doc' || doc_id AS doc_name, k AS item_idx, ['text', 'image', 'table'][k + 1] AS type, CASE k WHEN 0 THEN text END AS text, k AS page_idx,
  CASE k WHEN 1 THEN 'caption of ' || source ELSE '' END AS captions, CASE k WHEN 2 THEN '<table>' || chr(10) || '<tr><td>' || lang || '</td><td></td></tr>' || chr(10) || '</table>' END AS table_body
FROM documents, unnest(range(3)) AS t(k) WHERE doc_id % 10 <> 0""")
def read_content_lists(spark, sf):
    """Text without a type, an image with its caption as one string, a table given by cells; bad files left out."""
    grid = F.struct(F.lit(1).alias("num_rows"), F.lit(2).alias("num_cols"),
                    F.array(F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("lang").alias("text"))).alias("table_cells"))
    parts = [F.to_json(F.struct("text", F.lit(0).alias("page_idx"))),
             F.to_json(F.struct(F.lit("image").alias("type"), F.lit(1).alias("page_idx"), F.concat(F.lit("caption of "), F.col("source")).alias("image_caption"))),
             F.to_json(F.struct(F.lit("table").alias("type"), F.lit(2).alias("page_idx"), grid.alias("table_body")))]
    value = F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    files = _listed(spark, sf, value).select(F.concat("name", F.lit("_content_list.json")).alias("file_name"), "value")
    items = R.parse_content_lists(R.split_corrupt(files)[0])
    return items.select("doc_name", "item_idx", "type", "text", "page_idx", F.array_join("image_caption", "|").alias("captions"), "table_body")


@query("dead_letters", """
SELECT 'doc' || doc_id AS file, 'invalid JSON' AS error, 'manual_review' AS fallback_strategy, '[解析失败] doc' || doc_id || ': invalid JSON' AS placeholder
FROM documents WHERE doc_id % 10 = 0""")
def dead_letters(spark, sf):
    """Unreadable files as dead letters, written and read back, with the item that stands in for each."""
    folder = _scratch(spark) + "/dead"
    _, bad = R.split_corrupt(_listed(spark, sf, F.to_json(F.array("text"))).withColumnRenamed("name", "file_name"))
    W.write_dead_letters(bad, folder)
    back = spark.read.schema("file string, error string, timestamp string, fallback_strategy string").json(folder)
    text = W.placeholder_items(back).select(F.col("doc_name").alias("file"), F.col("text").alias("placeholder"))
    return back.join(text, "file").select("file", "error", "fallback_strategy", "placeholder")


@query("write_items", "WITH " + I.ITEMS + " SELECT doc_name, item_idx, type, text, page_idx FROM items")
def write_items(spark, sf):
    folder = _scratch(spark) + "/items"
    W.write_items(I.items(spark, sf), folder)
    return spark.read.schema("doc_name string, item_idx bigint, type string, text string, page_idx bigint").json(folder)


@query("write_pages", "SELECT page_id AS page_idx, url AS text FROM pages")
def write_pages(spark, sf):
    folder = _scratch(spark) + "/pages"
    W.write_pages(I.table(spark, sf, "pages").select(F.col("page_id").alias("page_idx"), F.col("url").alias("text")), folder)
    return spark.read.parquet(folder)


@query("write_report", "SELECT lang, count(*) AS documents, round(avg(n_chars), 6) AS mean FROM documents GROUP BY lang")
def write_report(spark, sf):
    folder = _scratch(spark) + "/report"
    d = I.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.avg("n_chars").alias("mean"))
    W.write_report(d, folder)
    return spark.read.schema("lang string, documents bigint, mean double").json(folder)


@query("vision_map", "SELECT upper(n_name) AS data, CASE WHEN n_name LIKE 'A%' THEN 'second' ELSE 'first' END AS model, n_name LIKE 'A%' AS fallback FROM nation")
def vision_map(spark, sf):
    """Files written from a table and read as bytes, through a chain whose first model fails on some."""
    folder = _scratch(spark) + "/images"
    _text_files(I.table(spark, sf, "nation").select(F.col("n_name").alias("value")), folder)

    def first(content: bytes) -> str:
        if content[:1] == b"A":
            raise RuntimeError("model down")
        return content.decode().strip().upper()

    chain = [("first", first), ("second", lambda content: content.decode().strip().upper())]
    images = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    return MM.vision_map(images, chain, retries=1, base=0.0).select("data", "model", "fallback")
