"""Readers: files, key-value stores, GraphML, audit logs and tables to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators.graph import build_edges, build_nodes
from marginalia.session import folder_exists
from marginalia.sources import schemas as S
from marginalia.sources.writers import kb_log


def read_whole_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """``(file_name, value)``, one row per file; batch or streaming."""
    reader = spark.readStream if stream else spark.read
    return reader.format("text").option("wholetext", True).load(path).select(
        F.col("_metadata.file_name").alias("file_name"), "value")


def split_corrupt(files: DataFrame, is_array: bool = True) -> tuple[DataFrame, DataFrame]:
    """Readable files and dead letters; one bad file never stops the others."""
    size = F.json_array_length("value") if is_array else F.size(F.json_object_keys("value"))
    ok = F.coalesce(size >= 0, F.lit(False))
    bad = files.where(~ok).select(F.col("file_name").alias("file"), F.lit("invalid JSON").alias("error"),
                                  F.current_timestamp().alias("timestamp"),
                                  F.lit("manual_review").alias("fallback_strategy"))
    return files.where(ok), bad


def _captions(c: str) -> Column:
    """A caption stored as a list or as one string, as a list."""
    raw = F.col(c)
    return (F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.from_json(raw, "array<string>"))
            .when(F.coalesce(raw, F.lit("")) != "", F.array(raw))
            .otherwise(F.array().cast("array<string>")))


def _table_body(c: str) -> Column:
    raw = F.col(c)
    grid = F.from_json(raw, S.TABLE_DICT)
    return F.when(F.startswith(F.ltrim(raw), F.lit("{")), T.table_cells_to_html(
        grid["table_cells"], grid["num_rows"], grid["num_cols"])).otherwise(raw)


def parse_content_lists(files: DataFrame) -> DataFrame:
    """Rows of content items from ``*_content_list.json`` files, array order kept in ``item_idx``."""
    items = files.select(
        F.regexp_replace("file_name", r"_content_list\.json$", "").alias("doc_name"),
        F.posexplode(F.from_json("value", f"array<struct<{_struct(S.CONTENT_ITEM)}>>")).alias("item_idx", "item"))
    out = items.select("doc_name", F.col("item_idx").cast("bigint").alias("item_idx"), "item.*")
    return (out.withColumn("type", F.coalesce("type", F.lit("text")))
            .withColumn("image_caption", _captions("image_caption"))
            .withColumn("table_caption", _captions("table_caption"))
            .withColumn("table_body", _table_body("table_body")))


def _struct(ddl: str) -> str:
    parts, depth, field = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(field.strip())
            field = ""
        else:
            field += ch
    parts.append(field.strip())
    return ",".join(p.replace(" ", ":", 1) for p in parts)


def read_content_lists(spark: SparkSession, folder: str) -> DataFrame:
    """All readable content lists of a folder."""
    good, _ = split_corrupt(read_whole_files(spark, f"{folder}/*_content_list.json"))
    return parse_content_lists(good)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_name, page_idx, text)`` of all readable ``*_pages.json`` files of a folder."""
    return parse_pages(split_corrupt(read_whole_files(spark, f"{folder}/*_pages.json"))[0])


def parse_pages(files: DataFrame) -> DataFrame:
    """``(doc_name, page_idx, text)`` from arrays of page texts."""
    return files.select(F.regexp_replace("file_name", r"_pages\.json$", "").alias("doc_name"),
                       F.posexplode(F.from_json("value", "array<string>")).alias("page_idx", "text")).select(
        "doc_name", F.col("page_idx").cast("bigint").alias("page_idx"), "text")


def _kv_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``(key, v)`` of an object of objects; members that are not objects are skipped."""
    good, _ = split_corrupt(read_whole_files(spark, path), is_array=False)
    raw = good.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "raw"))
    return raw.where(F.startswith(F.ltrim("raw"), F.lit("{"))).select("key", F.from_json("raw", schema).alias("v"))


def read_kv_entities(spark: SparkSession, path: str) -> DataFrame:
    return _kv_objects(spark, path, S.ENTITY).select(
        F.col("key").alias("name"), F.coalesce("v.count", F.lit(1)).alias("count"),
        F.coalesce("v.create_time", F.lit(0)).cast("bigint").alias("create_time"),
        F.coalesce("v.chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))


def read_kv_relations(spark: SparkSession, path: str) -> DataFrame:
    """Keys ``A<SEP>B`` split once and trimmed; keys without the separator are skipped."""
    ends = F.split("key", S.SEPARATOR, 2)
    return _kv_objects(spark, path, S.RELATION).where(F.contains("key", F.lit(S.SEPARATOR))).select(
        T.strip(ends[0]).alias("source"), T.strip(ends[1]).alias("target"),
        F.coalesce("v.count", F.lit(1)).alias("count"),
        F.coalesce("v.create_time", F.lit(0)).cast("bigint").alias("create_time"),
        F.coalesce("v.chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))


def read_graph(spark: SparkSession, entities: str, relations: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and a one-row status ``(error)``.

    A missing store gives empty tables and ``storage_not_found``, unreadable JSON leaves that
    store empty and gives ``parse_error``; otherwise the error is null.
    """
    if not (folder_exists(spark, entities) and folder_exists(spark, relations)):
        n = spark.createDataFrame([], f"name string, {S.ENTITY}")
        e = spark.createDataFrame([], f"source string, target string, {S.RELATION}")
        return build_nodes(n), build_edges(e), spark.createDataFrame([("storage_not_found",)], "error string")
    n, e = read_kv_entities(spark, entities), read_kv_relations(spark, relations)
    raw = read_whole_files(spark, entities).unionByName(read_whole_files(spark, relations))
    _, bad = split_corrupt(raw, is_array=False)
    status = bad.agg(F.when(F.count(F.lit(1)) > 0, "parse_error").alias("error"))
    return build_nodes(n), build_edges(e), status


def read_doc_status(spark: SparkSession, path: str) -> DataFrame:
    return _kv_objects(spark, path, S.DOC_STATUS).select(F.col("key").alias("doc_key"), "v.*")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a GraphML file as ``(…, attributes map)``; multi-values stay joined.

    Attribute names come from the file's key declarations.
    """
    def rows(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    keys = rows("key", S.XML_KEY).select(F.col("_id").alias("_key"), F.col("`_attr.name`").alias("name"))
    keys = keys.dropDuplicates(["_key"])

    def attributed(df: DataFrame, ids: list[str]) -> DataFrame:
        flat = df.select(*ids, F.explode_outer("data").alias("d")).withColumn("_key", F.col("d._key"))
        named = flat.join(keys, "_key", "left").where(F.col("name").isNotNull())
        return named.groupBy(*ids).agg(F.map_from_entries(F.collect_list(
            F.struct("name", F.col("d._VALUE").alias("value")))).alias("attributes"))

    nodes = attributed(rows("node", S.XML_NODE).withColumnRenamed("_id", "id"), ["id"])
    edges = attributed(rows("edge", S.XML_EDGE).withColumnsRenamed({"_source": "source", "_target": "target"}),
                       ["source", "target"])
    return nodes, edges


def multi_value(attributes: str, name: str) -> Column:
    """A ``<SEP>``-joined attribute as a list."""
    return F.split(F.try_element_at(F.col(attributes), F.lit(name)), S.SEPARATOR)


def read_audit(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """``(ts, type, payload)`` per JSON line, batch or streaming; bad lines are skipped.

    The set of keys is open, so a line's other fields stay in ``payload`` as JSON text.
    """
    lines = (spark.readStream if stream else spark.read).text(path)
    ok = F.json_object_keys("value").isNotNull()
    head = F.from_json("value", "ts timestamp, type string")
    return lines.where(ok).select(head["ts"].alias("ts"), head["type"].alias("type"),
                                  F.col("value").alias("payload")).where(F.col("type").isNotNull())


def audit_fields(log: DataFrame, event_type: str, schema: str) -> DataFrame:
    """Typed columns of one event type."""
    return log.where(F.col("type") == event_type).select("ts", F.from_json("payload", schema).alias("p")).select("ts", "p.*")


def read_table(spark: SparkSession, name: str, folder: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """A business table from a parquet folder, a catalog, or a database over JDBC.

    For JDBC pass ``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions`` so that the
    table is read by many tasks.
    """
    if jdbc:
        return spark.read.format("jdbc").options(**jdbc).option("dbtable", name).load()
    return spark.read.parquet(f"{folder}/{name}.parquet") if folder else spark.table(name)


def load_kb(spark: SparkSession, folder: str) -> DataFrame:
    """The stored chunk table as its committed batches leave it; empty where nothing was stored."""
    return kb_log(spark, folder).live("chunks")
