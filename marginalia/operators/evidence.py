"""Evidence grading and cross-document consistency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import grading as G
from marginalia.functions import rules, text as T
from marginalia.functions.rules import lookup
from marginalia.operators.keyed import top_n_per_key
from marginalia.operators.retrieval import topk_inner_product
from marginalia.session import written

# ---- fixed values: report wording ---------------------------------------------------------
OVERALL_GOOD = "整体证据质量较好，可基于此做出临床推荐"
OVERALL_LIMITED = "部分证据质量有限，建议谨慎解读并关注新研究"
OVERALL_LOW = "证据质量整体偏低，结论具有较大不确定性"
ALL_SUPPORT, ALL_AGAINST, ALL_NEUTRAL = "高度一致 (全部支持)", "高度一致 (全部反对)", "一致 (全部中性/不确定)"
PARTLY, CONTRADICTED, UNCLEAR = "部分一致 (支持+中性)", "存在矛盾", "结论方向不明确"
TOO_FEW = "文献不足 (<2篇)，无法进行一致性评估"
READ_SUPPORT = "%d篇文献结论方向一致，均支持该观点。证据链完整，结论可靠。"
READ_CONTRADICTED = ("%d篇支持 vs %d篇反对。建议优先采信证据等级更高的文献结论，并关注矛盾的可能原因"
                     "(样本量差异/研究设计差异/纳入人群差异)。")
READ_PARTLY = "%d篇支持，其余为中性结论。总体倾向于支持，但证据强度有限。"
READ_OTHER = "结论方向不够一致，建议更多研究验证。"
AGREE, DISAGREE = "一致", "方向不一致: %s vs %s"
# -------------------------------------------------------------------------------------------
MATRIX_HITS = 8


def assess_documents(docs: DataFrame, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Grade every document.

    ``docs(doc_id, title, evidence_type, findings array<string>, pico map<string,string>,
    effects array<struct>)``; ``keep`` names further columns to carry. Pure projection: no shuffle.
    """
    text = F.array_join("findings", " ")
    d = docs.withColumn("_text", text)
    cols = G.assess(F.col("_text"), F.col("evidence_type"), F.col("pico"), F.col("effects"), strict)
    d = d.select("doc_id", "title", *keep, *[c.alias(n) for n, c in cols.items()])
    return with_final_level(d)


def with_final_level(d: DataFrame) -> DataFrame:
    """Totals, clamped level, label and recommendation from the factor columns."""
    down = (F.col("risk_of_bias") + F.col("inconsistency") + F.col("indirectness")
            + F.col("imprecision") + F.col("publication_bias"))
    up = F.col("large_effect") + F.col("dose_response") + F.col("residual_confounding")
    d = d.withColumn("total_downgrade", down).withColumn("total_upgrade", up)
    d = d.withColumn("final_level", G.clamp_level(F.col("initial_level"), F.col("total_downgrade"),
                                                  F.col("total_upgrade")))
    return (d.withColumn("final_label", G.grade_label(F.col("final_level")))
            .withColumn("recommendation", G.recommendation(F.col("final_level"), F.col("total_downgrade"))))


def apply_corrections(assessed: DataFrame, corrections: DataFrame) -> DataFrame:
    """Override three factors from a reviewing model where it did not agree, and regrade.

    ``corrections(doc_id, agree, risk_of_bias, inconsistency, imprecision, note)``. The
    recommendation stays that of the first grading.
    """
    c = corrections.select("doc_id", (~F.coalesce("agree", F.lit(False))).alias("_apply"),
                           *[F.col(x).alias(f"_{x}") for x in ("risk_of_bias", "inconsistency", "imprecision")],
                           F.col("note").alias("summary_of_findings"))
    out = assessed.withColumn("_keep", F.col("recommendation")).join(c, "doc_id", "left")
    for x in ("risk_of_bias", "inconsistency", "imprecision"):
        out = out.withColumn(x, F.when(F.col("_apply"), F.coalesce(f"_{x}", x)).otherwise(F.col(x)))
    out = with_final_level(out).withColumn("recommendation", F.col("_keep"))
    return out.drop("_keep", "_apply", "_risk_of_bias", "_inconsistency", "_imprecision")


def grade_profile(assessed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Documents per final level and the overall reading, for all or per group."""
    counts = [F.count_if(F.col("final_level") == lv).alias(n.lower()) for lv, n in G.GRADE_NAMES.items()]
    g = assessed.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total_assessed"), *counts)
    return g.withColumn("overall", F.when(
        F.col("high") + F.col("moderate") >= F.col("total_assessed") * 0.5, OVERALL_GOOD)
        .when(F.col("low") > 0, OVERALL_LIMITED).otherwise(OVERALL_LOW))


def hit_findings(hits: DataFrame, topic: str = "query_id", keep: int = 500) -> DataFrame:
    """Direction, evidence label and effect of each hit of a topic, eight per topic."""
    best = hits.where(F.col("rank") <= MATRIX_HITS).withColumn("_t", F.left("text", F.lit(keep)))
    stored = F.col("evidence_label") if "evidence_label" in hits.columns else F.lit(None).cast("string")
    label = F.coalesce(F.when(stored != "", stored), rules.evidence_label_matrix("_t"))
    return best.select(topic, "rank", "source", label.alias("evidence"),
                       rules.direction("_t").alias("direction"), F.left("_t", F.lit(200)).alias("quote"),
                       T.effect("_t").alias("effect"))


def consistency_verdict(findings: DataFrame, topic: str = "query_id") -> DataFrame:
    """Verdict and reading per topic from the directions of its findings."""
    g = findings.groupBy(topic).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("direction") == "supportive").alias("supportive"),
        F.count_if(F.col("direction") == "against").alias("against"),
        F.count_if(F.col("direction") == "neutral").alias("neutral"))
    n, s, a = F.col("documents"), F.col("supportive"), F.col("against")
    verdict = (F.when(n < 2, TOO_FEW).when(s == n, ALL_SUPPORT).when(a == n, ALL_AGAINST)
               .when(F.col("neutral") == n, ALL_NEUTRAL).when((s > 0) & (a == 0), PARTLY)
               .when((s > 0) & (a > 0), CONTRADICTED).otherwise(UNCLEAR))
    g = g.withColumn("consistency", verdict)
    v = F.col("consistency")
    return g.withColumn("interpretation", F.when(v == TOO_FEW, F.lit(None).cast("string"))
                        .when(v == ALL_SUPPORT, F.format_string(READ_SUPPORT, n))
                        .when(v == CONTRADICTED, F.format_string(READ_CONTRADICTED, s, a))
                        .when(v == PARTLY, F.format_string(READ_PARTLY, s)).otherwise(READ_OTHER))


def evidence_distribution(findings: DataFrame, topic: str = "query_id") -> DataFrame:
    return findings.groupBy(topic, F.coalesce("evidence", F.lit("unknown")).alias("evidence")).agg(
        F.count(F.lit(1)).alias("documents"))


def compare_pairs(findings: DataFrame, topic: str = "query_id") -> DataFrame:
    """All pairs of a topic's findings, strongest evidence first.

    Every finding given takes part; how many a topic has is decided where they are searched
    (``hit_findings`` keeps eight). The pairs are the result, so they come from an equi join on the
    topic and never stand in one row.
    """
    order = lookup(F.coalesce("evidence", F.lit("unknown")), rules.MATRIX_LABEL_ORDER, 6)
    w = W.partitionBy(topic).orderBy(order, "rank", "source")
    f = findings.select(topic, "source", "evidence", "direction", F.row_number().over(w).alias("no"))
    a, b = (f.select(topic, *[F.col(c).alias(f"{side}_{c}") for c in ("no", "source", "evidence", "direction")]) for side in "ab")
    p = a.join(b, topic).where(F.col("a_no") < F.col("b_no"))
    same = F.col("a_direction") == F.col("b_direction")
    return p.select(
        topic, F.concat(F.lit("文献"), F.col("a_no").cast("string"), F.lit(" vs 文献"), F.col("b_no").cast("string")).alias("pair"),
        F.col("a_source").alias("doc_a"), F.col("b_source").alias("doc_b"), same.alias("direction_match"),
        F.col("a_evidence").alias("evidence_a"), F.col("b_evidence").alias("evidence_b"),
        F.when(same, AGREE).otherwise(F.format_string(DISAGREE, F.col("a_direction"), F.col("b_direction"))).alias("conflict"))


def estimate_grade(hits: DataFrame, key: str = "query_id", top: int = 3, keep: int = 1000,
                   unlabelled: str = "unknown") -> DataFrame:
    """Grade per query from its best passages: joined texts, label by rule, no PICO, no effects.

    ``top=5, keep=600, unlabelled='mixed'`` is the whole-topic form.
    """
    return assess_texts(best_texts(hits, key, top, keep), unlabelled)


def best_texts(hits: DataFrame, key: str, top: int, keep: int) -> DataFrame:
    """``(_key, _text)``: the heads of a query's best passages, joined in their order."""
    rows = F.array_sort(F.collect_list(F.struct("rank", F.left("text", F.lit(keep)).alias("t"))))
    return hits.where(F.col("rank") <= top).groupBy(F.col(key).alias("_key")).agg(
        F.array_join(F.transform(rows, lambda r: r["t"]), " ").alias("_text"))


def assess_texts(texts: DataFrame, unlabelled: str) -> DataFrame:
    """Grade of each ``(_key, _text)`` by its text alone: label by rule, no PICO, no effects."""
    docs = texts.select(
        F.col("_key").alias("doc_id"), F.col("_key").cast("string").alias("title"),
        F.coalesce(rules.evidence_label("_text"), F.lit(unlabelled)).alias("evidence_type"),
        F.array("_text").alias("findings"), F.create_map().cast("map<string,string>").alias("pico"),
        F.array().cast(G.EFFECT_TYPE).alias("effects"))
    # the label is compared as written here: it never equals a synthesis type
    return assess_documents(docs, strict=True)


# ---- fixed values: name of an assessment over a whole topic --------------------------------
WHOLE_TOPIC = "综合"
# -------------------------------------------------------------------------------------------


def grade_requests(requests: DataFrame, encode: Callable[[DataFrame, str], DataFrame], vectors: DataFrame,
                   chunks: DataFrame) -> DataFrame:
    """Grades asked for by topic: of the documents named, or of the topic where none of them gives hits.

    ``requests(request_id, topic, doc_names array<string>)``; ``encode`` turns ``(query_id, text)`` into
    vectors. Each name is searched once, however many requests name it (three passages). Only topics
    of requests without any assessed document are searched, in a second pass (five passages); a topic
    without hits is graded on no text. Gives ``(request_id, doc_id, ...)`` with the factors, levels and
    recommendation of ``assess_documents``; profiles come from ``grade_profile(..., ["request_id"])``.
    The first pass is written to the shared folder, since both the result and the choice read it.
    ``vectors`` are read by both passes, once each: hand in stored ones.
    """
    def found(asked: DataFrame, k: int, keep: int) -> DataFrame:
        hits = topk_inner_product(encode(asked.select(F.col("query").alias("query_id"), F.col("query").alias("text")), "text"), vectors, k)
        heads = chunks.select("vec_id", F.left("text", F.lit(keep)).alias("text"))
        return best_texts(hits.join(heads, "vec_id"), "query_id", k, keep)

    names = requests.select("request_id", F.explode("doc_names").alias("query"))
    of_names = assess_texts(found(names.select("query").distinct(), 3, 1000), "unknown")
    first = written(names.distinct().join(of_names, F.col("query") == F.col("doc_id")).select("request_id", *of_names.columns))
    without = requests.join(first.select("request_id").distinct(), "request_id", "left_anti").select(
        "request_id", F.coalesce("topic", F.lit("")).alias("query"))
    asked = without.select("query").distinct()
    topics = assess_texts(asked.join(found(asked, 5, 600), F.col("query") == F.col("_key"), "left").select(
        F.col("query").alias("_key"), F.coalesce("_text", F.lit("")).alias("_text")), "mixed")
    second = without.join(topics, F.col("query") == F.col("doc_id")).select("request_id", *of_names.columns).withColumns(
        {"doc_id": F.lit(WHOLE_TOPIC), "title": F.lit(WHOLE_TOPIC)})
    return first.unionByName(second)


def grade_corpus(documents: DataFrame, encode: Callable[[DataFrame, str], DataFrame], vectors: DataFrame, chunks: DataFrame,
                 top: int = 3, keep: int | None = None) -> DataFrame:
    """Grade of every stored document from the passages that its own name finds.

    ``documents(doc_name, evidence_type)``, one row per document; one without hits is graded on no
    findings. Passages are read whole, or their first ``keep`` characters. Names that find the same
    passages are graded by the same text: it is put together and searched once per evidence type.
    """
    asked = documents.select(F.col("doc_name").alias("query_id"), F.col("doc_name").alias("text"))
    hits = topk_inner_product(encode(asked, "text"), vectors, top)
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("_found"))  # top places
    named = written(documents.join(lists, F.col("doc_name") == F.col("query_id"), "left").select("doc_name", "evidence_type", "_found"))
    # only texts that were found meet the lists
    places = written(named.select("_found").distinct().select("_found", F.inline("_found")))
    text = F.col("text") if keep is None else F.left("text", F.lit(keep))
    texts = written(chunks.select("vec_id", text.alias("t")).join(places.select("vec_id").distinct(), "vec_id", "left_semi"))
    rows = F.array_sort(F.collect_list(F.struct("rank", "t")))
    per = places.join(texts, "vec_id").groupBy("_found").agg(F.transform(rows, lambda r: r["t"]).alias("findings"))
    each = named.groupBy("_found", "evidence_type").agg(F.first("doc_name").alias("doc_id")).join(per, "_found", "left")
    grades = written(assess_documents(each.select(
        "doc_id", F.col("doc_id").alias("title"), "evidence_type", "_found", F.coalesce("findings", F.array().cast("array<string>")).alias("findings"),
        F.create_map().cast("map<string,string>").alias("pico"), F.array().cast(G.EFFECT_TYPE).alias("effects")), keep=("evidence_type", "_found")))
    same = named["_found"].eqNullSafe(grades["_found"]) & named["evidence_type"].eqNullSafe(grades["evidence_type"])
    rest = [c for c in grades.columns if c not in ("doc_id", "title", "evidence_type", "_found")]
    return named.join(grades, same).select(F.col("doc_name").alias("doc_id"), F.col("doc_name").alias("title"), *rest)


def evidence_summary(evidence: DataFrame) -> DataFrame:
    """Documents per evidence level name."""
    return evidence.groupBy(rules.level_name("evidence_level").alias("level")).agg(
        F.count(F.lit(1)).alias("documents"))


def documents_by_level(evidence: DataFrame) -> DataFrame:
    """Titles under each evidence level name, a row per document."""
    return evidence.select(rules.level_name("evidence_level").alias("level"), "doc_title")


def relation_summary(relations: DataFrame) -> DataFrame:
    """Relations per type."""
    return relations.groupBy("relation_type").agg(F.count(F.lit(1)).alias("relations"))


def evidence_overview_text(evidence: DataFrame, relations: DataFrame, shown: int = 20) -> DataFrame:
    """The knowledge base in words: size, documents per level, first relations. One row.

    Only one row per level and ``shown`` relations reach the final aggregate.
    """
    by_level = evidence_summary(evidence)
    lines = by_level.where(F.col("level") != "UNKNOWN").select(
        F.lit(1).alias("part"), F.col("level").alias("o"), F.format_string("证据等级%s: %d篇", "level", "documents").alias("line"))
    total = by_level.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("n")).select(
        F.lit(0).alias("part"), F.lit("").alias("o"), F.format_string("知识库共%d篇文献", "n").alias("line"))
    first = relations.orderBy("relation_id").limit(shown).select(
        F.lit(3).alias("part"), F.format_string("%020d", "relation_id").alias("o"),
        F.format_string("  %s --[%s]--> %s", "source", "relation_type", "target").alias("line"))
    head = first.limit(1).select(F.lit(2).alias("part"), F.lit("").alias("o"), F.lit("\n关键医学关系:").alias("line"))
    rows = F.array_sort(F.collect_list(F.struct("part", "o", "line")))
    return total.unionByName(lines).unionByName(head).unionByName(first).agg(
        F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("overview"))


def compare_tables(hits: DataFrame, docs_wanted: DataFrame, top: int = 5) -> DataFrame:
    """Per document: table hits, their previews and sampled percentages.

    ``hits(doc, rank, type, text, page_idx)`` are the best hits for each document name;
    ``docs_wanted(doc)`` needs at least two rows for a comparison.
    """
    best = hits.join(docs_wanted.select("doc").distinct(), "doc", "left_semi")
    best = best.where(F.col("rank") <= top)
    rows = F.array_sort(F.collect_list(F.struct(
        "rank", F.col("type"), F.left("text", F.lit(500)).alias("preview"), T.percents("text").alias("nums"))))
    g = best.groupBy("doc").agg(rows.alias("r"))
    tables = F.transform(F.filter("r", lambda x: x["type"] == "table"), lambda x: x["preview"])
    return g.select("doc", F.size(tables).cast("bigint").alias("tables_found"),
                    F.slice(tables, 1, 3).alias("tables"),
                    F.slice(F.flatten(F.transform("r", lambda x: x["nums"])), 1, 10).alias("numeric_samples"))


def document_percents(chunks: DataFrame, per_chunk: int = 5, per_doc: int = 10) -> DataFrame:
    """First percentages of a document, five per chunk at most, ten in all, in chunk order."""
    some = chunks.select("doc_name", "chunk_idx", F.posexplode(T.percents("text", per_chunk)).alias("pos", "value"))
    return top_n_per_key(some, ["doc_name"], [F.col("chunk_idx").asc(), F.col("pos").asc()], per_doc)

