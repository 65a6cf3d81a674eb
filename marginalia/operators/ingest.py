"""From parsed content items to gated, deduplicated and labelled chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import rules, text as T
from marginalia.operators.keyed import first_per_key, top_n_per_key

# ---- fixed values: tags in front of non-text chunks ---------------------------------------
TAG_ANALYSED, TAG_IMAGE, TAG_TABLE = "[图表-VLM分析] ", "[图片] ", "[表格] "
# -------------------------------------------------------------------------------------------
MIN_TEXT, MIN_CAPTION, MIN_PREPROCESS = 30, 10, 10


def drop_cross_engine_duplicates(docs: DataFrame, name: str = "doc_name",
                                 prefix: str = "mineru_") -> DataFrame:
    """Drop ``<prefix>X`` where ``X`` was parsed too."""
    originals = docs.select(F.col(name).alias("_original")).distinct()
    bare = F.when(F.startswith(F.col(name), F.lit(prefix)), F.substring(F.col(name), len(prefix) + 1, 1 << 30))
    return docs.withColumn("_bare", bare).join(
        originals, F.col("_bare") == F.col("_original"), "left_anti").drop("_bare")


def preprocess_items(items: DataFrame) -> DataFrame:
    """Keep text of at least 10 characters and every image, table and equation."""
    long_enough = (F.col("type") == "text") & (F.length(T.strip("text")) >= MIN_PREPROCESS)
    return items.where(long_enough | F.col("type").isin("image", "table", "equation"))


def chunk_text(kind: Column, text: Column, caption: Column, body: Column,
               analysis: Column | None = None) -> Column:
    """Searchable text of an item, null where the item is not searchable.

    ``caption`` is ``array<string>`` for images and tables; ``analysis`` is the optional result
    struct of a vision model (see ``functions.analysis``).
    """
    joined = F.array_join(caption, " ")
    plain = T.strip(text)
    image = F.when(F.length(joined) > MIN_CAPTION, F.concat(F.lit(TAG_IMAGE), joined))
    if analysis is not None:
        block = F.concat(F.lit(TAG_ANALYSED), T.chart_keywords(analysis["chart_type"]),
                         F.lit(" 类型:"), F.coalesce(analysis["chart_type"], F.lit("?")), F.lit("\n"),
                         F.coalesce(analysis["summary"], F.lit("")), F.lit("\n"),
                         F.coalesce(analysis["description"], F.lit("")))
        image = F.when(analysis.isNotNull(), block).otherwise(image)
    table = F.concat(F.lit(TAG_TABLE), joined, F.lit("\n"), body)
    return (F.when((kind == "text") & (F.length(plain) > MIN_TEXT), plain)
            .when(kind.isin("image", "chart"), image)
            .when((kind == "table") & (T.strip(body) != "") & (F.length(table) > MIN_TEXT), table))


def offered_chunks(items: DataFrame, analysis: str | None = None) -> DataFrame:
    """One row per item, in item order, with its source label and content hash; text and hash are null where it is not searchable."""
    caption = F.when(F.col("type") == "table", F.col("table_caption")).otherwise(F.col("image_caption"))
    content = chunk_text(F.col("type"), F.col("text"),
                         F.coalesce(caption, F.array().cast("array<string>")),
                         F.coalesce(F.col("table_body"), F.lit("")),
                         F.col(analysis) if analysis else None)
    analysed = F.col(analysis).isNotNull() if analysis else F.lit(False)
    path = F.coalesce(F.col("img_path"), F.lit(""))
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return items.withColumn("_text", content).select(
        "doc_name", F.col("item_idx").alias("chunk_idx"), "type",
        F.col("page_idx"), F.col("_text").alias("text"),
        T.format_source("doc_name", "page_idx", "type").alias("source"),
        T.content_md5("_text").alias("content_md5"),
        F.when(F.col("type").isin("image", "chart") & (name != ""),
               F.concat(F.lit("/images/"), name)).alias("image_url"),
        (F.col("type").isin("image", "chart") & analysed).alias("vlm_analyzed"))


def items_to_chunks(items: DataFrame, analysis: str | None = None) -> DataFrame:
    """One chunk per searchable item, in item order, with its source label and content hash."""
    return offered_chunks(items, analysis).where(F.col("text").isNotNull())


def quality_gate(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Drop short text, generation loops and chunks that are mostly noise characters."""
    return chunks.where((F.length(text) >= MIN_TEXT) & (T.noise_ratio(text) <= 0.5)
                        & ~T.is_generation_loop(text))


def keep_first_copy(chunks: DataFrame) -> DataFrame:
    """Exact dedup over the whole corpus: the first chunk in (document, position) order stays."""
    return first_per_key(chunks, ["content_md5"], ["doc_name", "chunk_idx"])


def tag_sections(chunks: DataFrame, rule_set: rules.Rules = rules.SECTION_RULES) -> DataFrame:
    """Section tag of text chunks; other chunks stay untagged."""
    return chunks.withColumn(
        "section_tag",
        F.when(F.col("type") == "text", rules.classify_section(F.col("text"), rule_set)))


def build_chunks(items: DataFrame, analysis: str | None = None) -> DataFrame:
    """Items to knowledge-base chunks: filter, dedup, gate, label. One shuffle (on the hash).

    The gate looks at the text alone, so equal copies pass or fail together and it may run after
    the dedup, once per distinct text.
    """
    return tag_sections(quality_gate(keep_first_copy(items_to_chunks(items, analysis))))


def enrich_items(chunks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Chunk type, entities, summary line and evidence level, and the enriched text."""
    if titles is not None:
        chunks = chunks.join(titles, "doc_name", "left")
    title = F.coalesce(F.col("doc_title"), F.lit(""))
    return (chunks.withColumn("chunk_type", rules.chunk_type("text"))
            .withColumn("entities", T.extract_entities("text"))
            .withColumn("one_liner", T.one_liner("text"))
            .withColumn("evidence_level", rules.evidence_level(F.col("text"), title))
            .withColumn("enriched", T.enrich_text(title, "text", "one_liner", "entities")))


def preview_text(items: DataFrame) -> DataFrame:
    """Review rows of text and table items."""
    t = T.strip("text")
    text_rows = items.where((F.col("type") == "text") & (F.length(t) > MIN_TEXT)).select(
        "doc_name", "item_idx", F.lit("text").alias("type"), F.left(t, F.lit(300)).alias("preview"),
        rules.classify_section(t).alias("section_tag"), F.col("page_idx").alias("page"),
        T.length(t).alias("length"))
    cap = F.array_join(F.coalesce("table_caption", F.array().cast("array<string>")), " ")
    body = F.left(F.coalesce("table_body", F.lit("")), F.lit(200))
    table_rows = items.where((F.col("type") == "table") & ((cap != "") | (body != ""))).select(
        "doc_name", "item_idx", F.lit("table").alias("type"), F.concat(cap, F.lit("\n"), body).alias("preview"),
        F.lit(None).cast("string").alias("section_tag"), F.col("page_idx").alias("page"),
        F.lit(None).cast("bigint").alias("length"))
    return text_rows.unionByName(table_rows)


def preview_images(items: DataFrame) -> DataFrame:
    cap = F.array_join(F.coalesce("image_caption", F.array().cast("array<string>")), " ")
    return items.where((F.col("type") == "image") & (cap != "")).select(
        "doc_name", "item_idx", F.left(cap, F.lit(200)).alias("caption"), F.col("page_idx").alias("page"))


def first_pages_text(page_texts: DataFrame, pages: int = 3, keep: int = 4000) -> DataFrame:
    """Start of each document: its first three pages joined, cut to 4000 characters.

    Only the best three pages per document are gathered (cut before the shuffle).
    """
    first = top_n_per_key(page_texts, ["doc_name"], [F.col("page_idx").asc()], pages)
    ordered = F.array_sort(F.collect_list(F.struct("page_idx", "text")))
    return first.groupBy("doc_name").agg(
        F.left(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n"), F.lit(keep)).alias("text"))
