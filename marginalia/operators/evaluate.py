"""Evaluation of retrieval, chunking, parsing and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.keyed import with_previous, with_running_sum


def retrieval_metrics(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Keyword hit rate, recall@5, precision@5 and reciprocal rank per evaluation case.

    ``cases(query_id, category, keywords)``, ``hits(query_id, rank, text)`` with at most ten
    hits a case, which are put side by side so that keywords are tested on the joined text as
    specified. Cases without hits score zero.
    """
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.lower("text").alias("t"))))
    per = hits.where(F.col("rank") <= 10).groupBy("query_id").agg(ranked.alias("h"))
    c = cases.withColumn("k", F.transform("keywords", F.lower)).join(per, "query_id", "left")
    h = F.coalesce(F.col("h"), F.array().cast("array<struct<rank:int,t:string>>"))
    c = c.withColumn("h", h)
    top5 = F.slice("h", 1, 5)
    n_kw = F.greatest(F.size("k"), F.lit(1))

    def hit_share(text: Column) -> Column:
        return F.size(F.filter("k", lambda k: F.contains(text, k))) / n_kw

    def relevant(x: Column) -> Column:
        return F.exists("k", lambda k: F.contains(x["t"], k))

    c = c.withColumn("_all", F.array_join(F.transform("h", lambda x: x["t"]), " "))
    c = c.withColumn("_top5", F.array_join(F.transform(top5, lambda x: F.left(x["t"], F.lit(500))), " "))
    first = F.get(F.filter("h", relevant), F.lit(0))["rank"]
    return c.select(
        "query_id", "category", F.size("k").cast("bigint").alias("keywords"),
        F.size(F.filter("k", lambda k: F.contains(F.col("_all"), k))).cast("bigint").alias("keyword_hits"),
        hit_share(F.col("_all")).alias("keyword_hit_rate"), hit_share(F.col("_top5")).alias("recall_at_5"),
        (F.size(F.filter(top5, relevant)) / F.greatest(F.size(top5), F.lit(1))).alias("precision_at_5"),
        F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank"),
        (F.size("h") > 0).alias("has_source"))


def retrieval_report(metrics: DataFrame) -> DataFrame:
    """Means over all cases and per category, in one aggregation (category null is the total)."""
    mean = lambda c: F.avg(c).alias(c)
    return metrics.rollup("category").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("keyword_hit_rate") >= 0.5).alias("successful"),
        mean("keyword_hit_rate"), mean("recall_at_5"), mean("precision_at_5"),
        F.avg("reciprocal_rank").alias("mrr"))


def quick_recall(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Case-sensitive keyword recall in the first 300 characters of the top five hits."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.left("text", F.lit(300)).alias("t"))))
    per = hits.where(F.col("rank") <= 5).groupBy("query_id").agg(
        F.array_join(F.transform(ranked, lambda x: x["t"]), " ").alias("_t"), F.count(F.lit(1)).alias("sources"))
    c = cases.join(per, "query_id", "left").withColumn("_t", F.coalesce("_t", F.lit("")))
    found = F.size(F.filter("keywords", lambda k: F.contains(F.col("_t"), k)))
    return c.select("query_id", found.cast("bigint").alias("keyword_hits"),
                    F.size("keywords").cast("bigint").alias("keywords_expected"),
                    (found / F.greatest(F.size("keywords"), F.lit(1))).alias("recall"),
                    F.coalesce("sources", F.lit(0)).cast("bigint").alias("sources"))


def chunking_quality(chunks: DataFrame) -> DataFrame:
    """Totals, integer mean length and tagged shares, per section tag and overall (tag null)."""
    has_pico = F.col("pico_dimension").isNotNull() if "pico_dimension" in chunks.columns else F.lit(False)
    tag = F.coalesce("section_tag", F.lit(""))
    g = chunks.select(F.when(tag == "", "unknown").otherwise(tag).alias("section_group"), (tag != "").alias("_t"),
                      has_pico.alias("_p"), F.length("text").alias("_len")).rollup("section_group").agg(
        F.count(F.lit(1)).alias("total_chunks"), F.sum("_len").alias("_chars"),
        F.count_if("_t").alias("_tagged"), F.count_if("_p").alias("_p"))
    n = F.greatest(F.col("total_chunks"), F.lit(1))
    return g.select("section_group", "total_chunks", F.floor(F.col("_chars") / n).cast("bigint").alias("avg_chunk_length"),
                    (F.col("_tagged") / n).alias("semantic_integrity"), (F.col("_p") / n).alias("pico_completeness"))


def chunking_comparison(chunks: DataFrame, size: int = 512) -> DataFrame:
    """Semantic chunks against cutting every ``size`` characters, measured per corpus.

    A fixed-size piece crosses a section when a tag change falls strictly inside it. Offsets
    are prefix sums, and a change at offset ``o`` lies in piece ``o div size``, so the crossing
    pieces are counted by grouping; no range join.
    """
    c = chunks.select("doc_name", "chunk_idx", "section_tag", F.length("text").cast("bigint").alias("n"))
    c = with_running_sum(c, ["doc_name"], "chunk_idx", "n", "offset")
    c = with_previous(c, ["doc_name"], "chunk_idx", ["section_tag"])
    change = F.col("prev_chunk_idx").isNotNull() & ~F.equal_null("section_tag", "prev_section_tag")
    inside = change & (F.col("offset") % size != 0)
    pieces = c.withColumn("piece", F.when(inside, F.floor(F.col("offset") / size)))
    crossing = pieces.where(F.col("piece").isNotNull()).select("doc_name", "piece").distinct().groupBy("doc_name") \
        .agg(F.count(F.lit(1)).alias("crossing"))
    docs = chunks.groupBy("doc_name").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))
    d = docs.join(crossing, "doc_name", "left")
    t = d.agg(F.sum("chunks").alias("semantic_chunks"), F.sum("chars").alias("chars"),
              F.sum(F.ceil(F.col("chars") / size)).alias("fixed_chunks"),
              F.coalesce(F.sum("crossing"), F.lit(0)).alias("crossing_chunks"))
    return t.select("semantic_chunks", (F.col("chars") / F.col("semantic_chunks")).alias("semantic_avg_length"),
                    "fixed_chunks", (F.col("chars") / F.col("fixed_chunks")).alias("fixed_avg_length"),
                    "crossing_chunks", (F.col("crossing_chunks") / F.col("fixed_chunks")).alias("crossing_share"))


def _pct(part: Column, whole: Column) -> Column:
    return F.bround(part / F.greatest(whole, F.lit(1)) * 100, 0).cast("bigint")


def _item_counts(items: DataFrame, keys: list[str]) -> DataFrame:
    k = F.col("type")
    image = k.isin("image", "chart")
    captioned = F.size(F.coalesce("image_caption", F.array().cast("array<string>"))) > 0
    html = F.startswith(F.coalesce("table_body", F.lit("")), F.lit("<table>"))
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct("page_idx").alias("pages"),
        F.count_if(k == "text").alias("text_items"), F.count_if(k == "table").alias("table_items"),
        F.count_if(image).alias("image_items"), F.count_if(k == "chart").alias("chart_items"),
        F.coalesce(F.sum(F.when(k == "text", F.length(F.coalesce("text", F.lit(""))))), F.lit(0)).alias("text_chars"),
        F.count_if((k == "table") & html).alias("html_tables"), F.count_if(image & captioned).alias("captioned"))


def parsing_quality(items: DataFrame) -> DataFrame:
    """Item counts and rates per document; rates are null where there is nothing to rate."""
    d = _item_counts(items, ["doc_name"])
    n = F.greatest(F.col("text_items"), F.lit(1))
    return d.select(
        "doc_name", "pages", "text_items", "table_items", "image_items", "chart_items",
        (F.col("items") - F.col("text_items") - F.col("table_items") - F.col("image_items")).alias("other_items"),
        "text_chars", F.bround(F.col("text_chars") / n, 0).cast("bigint").alias("avg_chars_per_text"),
        F.when(F.col("table_items") > 0, _pct(F.col("html_tables"), F.col("table_items"))).alias("table_html_rate"),
        F.when(F.col("image_items") > 0, _pct(F.col("captioned"), F.col("image_items"))).alias("image_caption_rate"))


def parsing_scores(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: five corpus scores of 0 to 100 and their rounded mean."""
    t = _item_counts(items, []).withColumn("_one", F.lit(1))
    docs = items.agg(F.count_distinct("doc_name").alias("docs")).withColumn("_one", F.lit(1))
    tags = chunks.agg(F.count_distinct(F.coalesce("section_tag", F.lit("unknown"))).alias("tags")).withColumn("_one", F.lit(1))
    t = t.join(F.broadcast(docs), "_one").join(F.broadcast(tags), "_one")
    hundred = F.lit(100).cast("bigint")
    avg_len = F.bround(F.col("text_chars") / F.greatest(F.col("text_items"), F.lit(1)), 0)
    scores = {
        "text_extraction": F.least(hundred, F.greatest(F.lit(0), F.bround(avg_len / 200 * 100, 0).cast("bigint"))),
        "table_structure": F.least(hundred, F.when(
            F.col("table_items") > 0, _pct(F.col("html_tables"), F.col("table_items"))).otherwise(70)),
        "image_coverage": F.least(hundred, _pct(F.col("captioned"), F.col("image_items"))),
        "section_classification": F.least(hundred, F.col("tags") * 12),
        "layout_handling": F.least(hundred, F.bround(F.col("pages") / F.greatest(F.col("docs"), F.lit(1)) * 15, 0)
                                   .cast("bigint")),
    }
    s = t.select("docs", *[c.cast("bigint").alias(n) for n, c in scores.items()])
    total = None
    for n in scores:
        total = F.col(n) if total is None else total + F.col(n)
    return s.withColumn("overall", F.bround(total / len(scores), 0).cast("bigint"))


def competency_report(results: DataFrame) -> DataFrame:
    """Weighted and plain means as ``(kind, name, score, cases)`` rows.

    ``results(category, dimension, weight, score)``, score null for a failed run: failed runs
    are left out of the overall and category means and count zero in a dimension.
    """
    passed = F.col("score").isNotNull()
    base = results.groupBy("category", "dimension").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("ok"),
        F.coalesce(F.sum("score"), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(F.col("score") * F.col("weight")), F.lit(0.0)).alias("sw"),
        F.coalesce(F.sum(F.when(passed, F.col("weight"))), F.lit(0.0)).alias("w"))
    div = lambda a, b: F.when(b > 0, a / b)
    overall = base.agg(*[F.sum(c).alias(c) for c in ("n", "ok", "s", "sw", "w")]).select(F.inline(F.array(
        F.struct(F.lit("overall").alias("kind"), F.lit("mean").alias("name"), div(F.col("s"), F.col("ok")).alias("score"), F.col("ok").alias("cases")),
        F.struct(F.lit("overall").alias("kind"), F.lit("weighted").alias("name"), div(F.col("sw"), F.col("w")).alias("score"), F.col("ok").alias("cases")))))
    cat = base.groupBy(F.col("category").alias("name")).agg(F.sum("s").alias("s"), F.sum("ok").alias("cases")).select(
        F.lit("category").alias("kind"), "name", div(F.col("s"), F.col("cases")).alias("score"), "cases")
    dim = base.groupBy(F.col("dimension").alias("name")).agg(F.sum("s").alias("s"), F.sum("n").alias("cases")).select(
        F.lit("dimension").alias("kind"), "name", div(F.col("s"), F.col("cases")).alias("score"), "cases")
    return overall.unionByName(cat).unionByName(dim)

