"""Chunking and the order-dependent operators on items and chunks of a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import rules, text as T
from marginalia.operators.keyed import pair_up, top_n_per_key, with_position, with_previous, with_run_start

# ---- fixed values: lines that open a section, and lines that look like table rows ---------
SECTION_HEADER = (
    r"^(METHODS?|RESULTS?|INTRODUCTION|DISCUSSION|CONCLUSIONS?|"
    r"References?|Abbreviations?\s*(and\s+Acronyms)?|"
    r"Study\s+(design|population)|Statistical\s+analysis|"
    r"Table\s+\d+|Figure\s+\d+|WORKS\s+IN\s+PROGRESS)")
TABLE_LINE = r"^.+(n\s*=|IQR|\[\d|\(\d+%\)|\d+\s+vs\s+\d+)"
FIGURE_HINTS = ["figure", "survival", "curve", "chart"]
# -------------------------------------------------------------------------------------------


def _pack(parts: Column, must_break, joiner: str, floor: int, ceiling: int) -> Column:
    """Greedy packing of an ordered array into joined pieces (a fold over one page's array).

    State: finished pieces, the open piece, and its length without joiners.
    """
    state = F.struct(F.array().cast("array<string>").alias("done"),
                     F.lit(None).cast("string").alias("open"), F.lit(0).alias("len"))

    def step(acc, p):
        n = F.length(p)
        flush = (acc["len"] > floor) & (must_break(p) | (acc["len"] + n > ceiling))
        return F.struct(
            F.when(flush, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(flush | acc["open"].isNull(), p)
            .otherwise(F.concat(acc["open"], F.lit(joiner), p)).alias("open"),
            F.when(flush, n).otherwise(acc["len"] + n).alias("len"))

    return F.aggregate(parts, state, step, lambda acc: F.when(
        acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def split_paragraphs(page: Column | str, floor: int = 250, ceiling: int = 1200) -> Column:
    """Paragraph chunks of one page as ``array<string>``.

    Blank-line paragraphs are packed up to ``ceiling``; a section header or a table-like line
    starts a new chunk once the open one exceeds ``floor``. Oversized chunks are packed again
    by sentence, short ones join the chunk before.
    """
    page = F.col(page) if isinstance(page, str) else page
    paras = F.filter(F.transform(F.split(page, rf"\n{T.SPACE}*\n"), T.strip), lambda p: p != "")
    opens = lambda p: p.rlike("(?i)" + SECTION_HEADER) | p.rlike(TABLE_LINE)
    chunks = _pack(paras, opens, "\n\n", floor, ceiling)
    never = lambda p: F.lit(False)

    def regroup(done, c):
        n = F.length(c)
        sentences = F.split(c, rf"(?<=[.!?]){T.SPACE}+")
        short = (n < floor) & (F.size(done) > 0)
        glued = F.concat(F.slice(done, 1, F.size(done) - 1),
                         F.array(F.concat(F.element_at(done, -1), F.lit("\n\n"), c)))
        return (F.when(n > ceiling, F.concat(done, _pack(sentences, never, " ", floor, ceiling)))
                .when(short, glued).otherwise(F.array_append(done, c)))

    return F.aggregate(chunks, F.array().cast("array<string>"), regroup)


def page_chunks(page_texts: DataFrame) -> DataFrame:
    """Pages to chunk rows ``(doc_name, page_idx, seq, text)``, generation loops dropped."""
    return (page_texts.select("doc_name", "page_idx", F.posexplode(split_paragraphs("text")).alias("seq", "text"))
            .where(~T.is_generation_loop("text")))


def fixed_size_chunks(df: DataFrame, text: str = "text", size: int = 512) -> DataFrame:
    """Cut a text column into consecutive pieces of ``size`` characters: ``seq``, ``piece``."""
    last = F.greatest(F.ceil(F.length(text) / size), F.lit(1)) - 1
    return (df.withColumn("seq", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
            .withColumn("piece", F.substring(F.col(text), (F.col("seq") * size + 1).cast("int"), F.lit(size)))
            .where(F.col("piece") != ""))


def merge_text_by_page(items: DataFrame) -> DataFrame:
    """Text items of a page joined by blank lines. A page is the output cell, hence the bound."""
    ordered = F.array_sort(F.collect_list(F.struct("item_idx", "text")))
    return (items.where(F.col("type") == "text").groupBy("doc_name", "page_idx")
            .agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text")))


def _join_in_order(idx: str, text: str, joiner: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(idx), F.col(text))))
    return F.array_join(F.transform(ordered, lambda x: x[text]), joiner)


def section_islands(paragraphs: DataFrame, rule_set: rules.Rules = rules.SECTION_RULES) -> DataFrame:
    """Runs of paragraphs with one section tag become sections.

    Input ``(doc_name, para_idx, page_idx, text)``. Paragraphs of 50 characters or less are
    ignored, the first section is always ``background``, the page is that of the paragraph
    that closed the section (the last page for the last one) and the parent is the tag before.
    """
    # ignored paragraphs count for the document's last page too: one window over all of them
    whole = W.partitionBy("doc_name")
    p = (paragraphs.withColumn("_last_page", F.max("page_idx").over(whole))
         .where(F.length(T.strip("text")) > 50)
         .withColumn("tag", rules.classify_section(F.col("text"), rule_set)))
    p = with_previous(p, ["doc_name"], "para_idx", ["tag"])
    first = F.col("para_idx") == F.col("first_para_idx")
    before = F.when(F.col("prev_para_idx") == F.col("first_para_idx"), F.lit("background")) \
        .otherwise(F.col("prev_tag"))
    p = p.withColumn("tag", F.when(first, F.lit("background")).otherwise(F.col("tag")))
    p = with_run_start(p, ["doc_name"], "para_idx", first | (F.col("tag") != before), "island")
    sections = p.groupBy("doc_name", "island").agg(
        F.first("tag").alias("section_tag"),
        F.count(F.lit(1)).alias("paragraphs"),
        T.strip(_join_in_order("para_idx", "text", "\n\n")).alias("content"),
        F.min_by("page_idx", "para_idx").alias("first_page"), F.first("_last_page").alias("_last_page"))
    sections = with_previous(sections, ["doc_name"], "island", ["section_tag"])
    # the paragraph that closes a section opens the next one: look one section ahead
    sections = sections.withColumn("back", -F.col("island"))
    sections = with_previous(sections, ["doc_name"], "back", ["first_page"])
    return (with_position(sections, ["doc_name"], "island", "seq")
            .select("doc_name", "seq", "section_tag", F.col("prev_section_tag").alias("parent_section"),
                    F.coalesce("prev_first_page", "_last_page").alias("page_idx"), "paragraphs", "content"))


def merge_adjacent(chunks: DataFrame) -> DataFrame:
    """Neighbouring chunks of one document with the same tag and page become one chunk.

    A merged chunk lies on one page, so its text is bounded by that page.
    """
    c = with_previous(chunks, ["doc_name"], "chunk_idx", ["section_tag", "page_idx"])
    same = (F.equal_null("section_tag", "prev_section_tag") & F.equal_null("page_idx", "prev_page_idx")
            & F.col("prev_chunk_idx").isNotNull())
    c = with_run_start(c, ["doc_name"], "chunk_idx", ~same, "run")
    merged = c.groupBy("doc_name", "run").agg(
        F.first("section_tag").alias("section_tag"), F.first("page_idx").alias("page_start"),
        F.first("page_idx").alias("page_end"), F.count(F.lit(1)).alias("merged"),
        _join_in_order("chunk_idx", "text", "\n").alias("text"),
        F.min_by("source", "chunk_idx").alias("_source"))
    spanned = F.concat(T.source_doc("_source"), F.lit(" [p."), F.col("page_start").cast("string"), F.lit("-"),
                       F.col("page_end").cast("string"), F.lit("]"))
    return with_position(merged, ["doc_name"], "run", "chunk_idx").select(
        "doc_name", "chunk_idx", "section_tag", "page_start", "page_end", "merged", "text",
        F.when(F.col("merged") > 1, spanned).otherwise(F.col("_source")).alias("source"))


def merge_candidates(merged: DataFrame, keep: int = 15, context: int = 150) -> DataFrame:
    """Adjacent chunks worth a semantic look: same tag across pages, or other tag on one page.

    The first ``keep`` per document go to the model, with the text around the seam.
    """
    # only the ends of a text are looked at: cut them before rows are sorted
    seams = merged.select("doc_name", "chunk_idx", "section_tag", "page_start", "page_end",
                          F.left("text", F.lit(context)).alias("head"), F.right("text", F.lit(context)).alias("tail"))
    c = with_previous(seams, ["doc_name"], "chunk_idx", ["section_tag", "page_end", "tail"])
    same_tag = F.equal_null("section_tag", "prev_section_tag")
    same_page = F.equal_null("page_start", "prev_page_end")
    reason = F.when(same_tag & ~same_page, "cross_page").when(~same_tag & same_page, "cross_tag")
    c = (c.where(F.col("prev_chunk_idx").isNotNull()).withColumn("reason", reason)
         .where(F.col("reason").isNotNull()))
    return top_n_per_key(c, ["doc_name"], [F.col("chunk_idx").asc()], keep, "rank").select(
        "doc_name", F.col("prev_chunk_idx").alias("pair"), "reason",
        F.col("prev_section_tag").alias("tag_a"), F.col("section_tag").alias("tag_b"),
        F.col("prev_tail").alias("tail"), "head")


def apply_merge_decisions(merged: DataFrame, decisions: DataFrame) -> DataFrame:
    """Merge the pairs a model agreed to, left to right, no chunk in two pairs.

    ``decisions(doc_name, pair, merge, confidence)``: ``pair`` is the position of the left
    chunk; only high and medium confidence counts.
    """
    agreed = decisions.where(F.col("merge") & F.col("confidence").isin("high", "medium")) \
        .select("doc_name", F.col("pair").alias("chunk_idx"), F.lit(True).alias("_merge")).distinct()
    c = merged.join(agreed, ["doc_name", "chunk_idx"], "left")
    c = pair_up(c, ["doc_name"], "chunk_idx", "_merge")
    out = c.groupBy("doc_name", "head").agg(
        F.min_by("section_tag", "chunk_idx").alias("section_tag"),
        F.min_by("page_start", "chunk_idx").alias("page_start"),
        F.max_by("page_end", "chunk_idx").alias("page_end"),
        F.count(F.lit(1)).alias("_n"), _join_in_order("chunk_idx", "text", "\n").alias("text"),
        F.min_by("source", "chunk_idx").alias("_source"))
    spanned = F.concat(T.source_doc("_source"), F.lit(" [p."), F.col("page_start").cast("string"), F.lit("-"),
                       F.col("page_end").cast("string"), F.lit("]"))
    return with_position(out, ["doc_name"], "head", "chunk_idx").select(
        "doc_name", "chunk_idx", "section_tag", "page_start", "page_end", "text",
        F.when(F.col("_n") > 1, spanned).otherwise(F.col("_source")).alias("source"),
        (F.col("_n") > 1).alias("model_merged"))


def merge_elements(items: DataFrame) -> DataFrame:
    """Short text joins what follows: under 300 characters a table, under 80 text of its page.
    Text that carries a table caption of its own joins no table.

    ``item_idx`` is dense within a document (as the reader delivers it). Pairs are consumed
    left to right, a merged item is not merged again.
    """
    i = items.withColumn("_back", -F.col("item_idx")).withColumn("_it", F.struct("type", "text", "page_idx", "table_body"))
    i = with_previous(i, ["doc_name"], "_back", ["_it"]).withColumnRenamed("prev__it", "_next")
    n = F.length(F.coalesce("text", F.lit("")))
    is_text = F.col("type") == "text"
    captioned = F.col("table_caption").isNotNull() if "table_caption" in items.columns else F.lit(False)
    to_table = is_text & ~captioned & (F.col("_next.type") == "table") & (n < 300)
    to_text = (is_text & (F.col("_next.type") == "text")
               & F.equal_null("page_idx", F.col("_next.page_idx")) & (n < 80))
    i = i.withColumn("_kind", F.when(to_table, "table").when(to_text, "text"))
    i = i.withColumn("eligible", F.col("_kind").isNotNull())
    i = pair_up(i, ["doc_name"], "item_idx", "eligible")
    # a row is absorbed when its head is the row before; the head carries the joined content
    body = F.coalesce(F.col("_next.table_body"), F.lit(""))
    text = (F.when(F.col("_kind") == "table", F.concat(F.lit("[表] "), F.col("text"), F.lit("\n"), body))
            .when(F.col("_kind") == "text", F.concat(F.col("text"), F.lit(" "), F.coalesce(F.col("_next.text"), F.lit(""))))
            .otherwise(F.col("text")))
    # inside a run the parity decides, so an eligible head absorbs and an absorbed row is gone
    return (i.where(F.col("head") == F.col("item_idx"))
            .select("doc_name", "item_idx",
                    F.when(F.col("_kind") == "table", "table").otherwise(F.col("type")).alias("type"),
                    "page_idx", text.alias("text"),
                    F.when(F.col("_kind") == "table", F.col("text")).alias("table_caption"),
                    F.when(F.col("_kind") == "table", body).otherwise(F.col("table_body")).alias("table_body"),
                    F.col("_kind").isNotNull().alias("merged")))


# ---- fixed values: marks of tables and figures written out by a model ----------------------
TABLE_WRITTEN, FIGURE_WRITTEN, TABLE_MARK = "[表格序列化] ", "[图表序列化] ", "[表] "
# -------------------------------------------------------------------------------------------
MIN_TABLE_BODY, SHOWN_BODY = 50, 500


def postprocess_items(items: DataFrame, written_out: DataFrame | None = None) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """Parsed items made ready for chunking: artefacts cleaned, short elements merged, tables written out.

    ``written_out(doc_name, item_idx, text)`` holds what a model made of tables and figures: its text
    takes the item's place; where the model failed (null text) a table keeps its caption and the
    start of its body. Tables with a body under 50 characters and items without a row stay.
    Gives the items with ``merged`` and ``serialized``, and a function that tells how many were
    cleaned, merged and serialized: the counts are observed in the one pass that any action makes
    (they wait for it; retried tasks of a shuffle may count twice).
    """
    text = F.col("text")
    cleaned = F.when(F.col("type") == "text", T.clean_ocr("text")).otherwise(text)
    seen, done = Observation(), Observation()
    rows = items.withColumns({"text": cleaned, "_cleaned": ~F.equal_null(cleaned, text)}).observe(
        seen, F.count_if("_cleaned").alias("cleaned")).drop("_cleaned")
    rows = merge_elements(rows)
    if written_out is None:
        rows = rows.withColumn("serialized", F.lit(False))
    else:
        made = written_out.select("doc_name", "item_idx", F.struct(F.col("text").alias("text")).alias("_made"))
        body, by = F.coalesce("table_body", F.lit("")), F.col("_made.text")
        table = (F.col("type") == "table") & (F.length(body) >= MIN_TABLE_BODY) & F.col("_made").isNotNull()
        figure = F.col("type").isin("image", "chart") & by.isNotNull()
        failed = F.concat(F.lit(TABLE_MARK), F.coalesce("table_caption", F.lit("")), F.lit("\n"), F.left(body, F.lit(SHOWN_BODY)))
        new = (F.when(table & by.isNotNull(), F.concat(F.lit(TABLE_WRITTEN), T.strip(by))).when(table, failed)
               .when(figure, F.concat(F.lit(FIGURE_WRITTEN), T.strip(by))).otherwise(text))
        rows = rows.join(made, ["doc_name", "item_idx"], "left").withColumns(
            {"text": new, "serialized": F.coalesce((table | figure) & by.isNotNull(), F.lit(False))}).drop("_made")
    rows = rows.observe(done, F.count_if("merged").alias("merged"), F.count_if("serialized").alias("serialized"))
    return rows, lambda: {**seen.get, **done.get}


def attach_figure_text(images: DataFrame, page_texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Text for an image: its page's figure line, the next page's, the one before's, the first
    chunk of the page that speaks of a figure, the caption, else a placeholder.

    What a page can offer is ranked in one aggregate, so the images meet it in a single join.
    """
    lines = (page_texts.select("doc_name", "page_idx", T.figure_description("text").alias("t"))
             .where(F.col("t").isNotNull()))
    # a line serves its own page first, then the page before it, then the page after it
    served = F.array(*[F.struct(F.lit(p).alias("o"), F.lit(0).cast("bigint").alias("i"), (F.col("page_idx") + by).alias("page_idx"))
                       for p, by in ((0, 0), (1, -1), (2, 1))])
    offers = lines.select("doc_name", "t", F.inline(served)).select("doc_name", "page_idx", "o", "i", "t")
    hinted = chunks.where(T.contains_any(F.lower("text"), FIGURE_HINTS)).select(
        "doc_name", "page_idx", F.lit(3).alias("o"), F.col("chunk_idx").cast("bigint").alias("i"),
        F.left("text", F.lit(300)).alias("t"))
    best = offers.unionByName(hinted).groupBy("doc_name", "page_idx").agg(
        F.min_by("t", F.struct("o", "i")).alias("_best"))
    out = images.join(best, ["doc_name", "page_idx"], "left")
    caption = F.when(F.coalesce("caption", F.lit("")) != "", F.concat(F.lit("[图片] "), F.col("caption")))
    placeholder = F.concat(F.lit("[图片 p"), F.col("page_idx").cast("string"), F.lit("]"))
    text = T.strip(F.coalesce("_best", caption, placeholder))
    return out.withColumn("text", F.when(text == "", placeholder).otherwise(text)).drop("_best")


def to_enhanced_items(sections: DataFrame, pico: DataFrame) -> DataFrame:
    """Sections with one block in front that lists the document's PICO parts.

    ``pico(doc_name, parts array<struct<dim,value>>)``; design fields are not listed.
    """
    shown = F.filter("parts", lambda p: (F.coalesce(p["value"], F.lit("")) != "")
                     & ~p["dim"].isin("evidence_type", "evidence_level"))
    lines = F.array_join(F.transform(shown, lambda p: F.concat(
        F.lit("- **"), F.upper(p["dim"]), F.lit("**: "), p["value"], F.lit("\n"))), "")
    block = pico.select("doc_name", F.lit(-1).cast("bigint").alias("seq"),
                        F.lit("pico_framework").alias("section_tag"), F.lit(0).cast("bigint").alias("page_idx"),
                        F.concat(F.lit("### PICO框架\n"), lines).alias("text"))
    rows = sections.select("doc_name", "seq", "section_tag", F.col("page_idx").cast("bigint").alias("page_idx"),
                           F.col("content").alias("text"))
    return block.unionByName(rows)


def inject_evidence_metadata(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Text items of a document take over its evidence level, type and title."""
    e = evidence.select("doc_name", F.col("evidence_level").alias("_level"),
                        F.col("evidence_type").alias("_type"), F.col("doc_title").alias("_title"))
    out = items.join(e, "doc_name", "left")
    is_text = F.col("type") == "text"
    return (out.withColumn("evidence_level", F.when(is_text, F.col("_level")))
            .withColumn("evidence_type", F.when(is_text, F.col("_type")))
            .withColumn("doc_title", F.when(is_text, F.col("_title")))
            .drop("_level", "_type", "_title"))


def build_segments(items: DataFrame) -> DataFrame:
    """Text items as numbered article segments."""
    t = items.where((F.col("type") == "text") & (F.coalesce("text", F.lit("")) != ""))
    return with_position(t, ["doc_name"], "item_idx", "_pos").select(
        "doc_name", (F.col("_pos") + 1).alias("sequence"), F.col("text").alias("content"),
        rules.segment_type("chunk_type").alias("segment_type"), F.col("section_tag").alias("section_title"),
        (F.col("page_idx") + 1).alias("page_number"), F.lit(0.9).alias("confidence"),
        T.length("text").alias("word_count"),
        F.coalesce(F.col("evidence_level").cast("string"), F.lit("")).alias("evidence_level"))


def build_figures(items: DataFrame) -> DataFrame:
    """Image and chart items as numbered article figures."""
    f = items.where(F.col("type").isin("image", "chart"))
    return with_position(f, ["doc_name"], "item_idx", "_pos").select(
        "doc_name", (F.col("_pos") + 1).alias("sequence"),
        F.when(F.col("type") == "chart", "chart").otherwise("figure").alias("figure_type"),
        F.coalesce("one_liner", F.lit("")).alias("caption"), F.coalesce("text", F.lit("")).alias("description"),
        (F.col("page_idx") + 1).alias("page_number"), F.lit(0.85).alias("confidence"),
        F.coalesce("img_path", F.lit("")).alias("img_path"))


def replace_children(existing: DataFrame, fresh: DataFrame, key: str = "doc_name") -> DataFrame:
    """Rows of re-synced parents replaced by their fresh ones, all others kept."""
    touched = fresh.select(key).distinct()
    return existing.join(touched, key, "left_anti").unionByName(fresh, allowMissingColumns=True)

