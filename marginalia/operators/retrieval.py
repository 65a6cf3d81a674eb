"""Exact vector search for batches of queries, and what is done with the hits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from marginalia.functions import rules, text as T
from marginalia.operators.keyed import first_per_key, top_n_per_key
from marginalia.operators.lookups import filter_hits_by_doc
from marginalia.session import written

MAX_QUERY_ROWS = 4_096  # query vectors shipped to every task: 32 MB at 1024 dimensions
GROUP_VECTORS = 65_536  # vectors that one task holds while queries pass: 512 MB at 1024 dimensions
MAX_HIT_ROWS = 1_000_000  # hits that may be broadcast to the chunk table: about 32 MB
SCORE_DIGITS = 12  # scores closer than this are a tie, broken by vec_id


def _better(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k`` entries of every row, ordered by (row, score desc, id)."""
    order = np.lexsort((ids, -scores, rows))
    sorted_rows = rows[order]
    starts = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < k]


def _scan(vectors: DataFrame, ids: pa.Array, matrix: np.ndarray, k: int, id_type: ST.DataType) -> DataFrame:
    """Best ``k`` vectors per query within each partition of the vectors, as hit rows."""
    shipped = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = shipped.value
        rows, found, scores = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        worst = np.full(len(q), -np.inf)  # k-th best so far: most scores of later batches fail it
        for batch in batches:
            m = batch.num_rows
            if m == 0 or not len(q):
                continue
            held = batch.column("embedding")
            whole = pc.fill_null(pc.equal(pc.list_value_length(held), q.shape[1]), False)
            batch = batch.filter(whole)  # null vectors and those of another length cannot be compared
            vec_id = batch.column("vec_id").to_numpy(zero_copy_only=False)
            v = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec_id), -1)
            sound = np.isfinite(v).all(axis=1)  # a null component reads as NaN
            vec_id, v = vec_id[sound], v[sound]
            m = len(vec_id)
            if m == 0:
                continue
            step = max(1, 4_000_000 // m)  # bounds the score block
            for at in range(0, len(q), step):
                block = np.round(q[at:at + step] @ v.T, SCORE_DIGITS)
                floor = worst[at:at + step]
                if m > k:
                    floor = np.maximum(floor, np.partition(block, m - k, axis=1)[:, m - k])
                r, c = np.nonzero(block >= floor[:, None])
                rows = np.concatenate([rows, r + at])
                found = np.concatenate([found, vec_id[c]])
                scores = np.concatenate([scores, block[r, c]])
                keep = _better(rows, found, scores, k)  # many equal scores pass the floor: cut at once
                rows, found, scores = rows[keep], found[keep], scores[keep]
            full = np.bincount(rows, minlength=len(q)) >= k
            last = np.searchsorted(rows, np.arange(len(q)), side="right") - 1
            worst = np.where(full, scores[np.maximum(last, 0)], -np.inf)
        if len(rows):
            yield pa.RecordBatch.from_arrays(
                [query_ids.take(pa.array(rows)), pa.array(found, pa.int64()), pa.array(scores, pa.float64())],
                names=["query_id", "vec_id", "score"])

    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(
        best, ST.StructType([ST.StructField("query_id", id_type), ST.StructField("vec_id", ST.LongType()),
                             ST.StructField("score", ST.DoubleType())]))


def _best_of(q: np.ndarray, v: np.ndarray, vec_id: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of q, vec_id, score) of the best ``k`` vectors of every query, block by block."""
    step = max(1, 4_000_000 // max(1, len(v)))  # bounds the score block
    for at in range(0, len(q), step):
        block = np.round(q[at:at + step] @ v.T, SCORE_DIGITS)
        floor = np.partition(block, len(v) - k, axis=1)[:, len(v) - k] if len(v) > k else np.full(len(block), -np.inf)
        r, c = np.nonzero(block >= floor[:, None])
        keep = _better(r, vec_id[c], block[r, c], k)
        yield r[keep] + at, vec_id[c[keep]], block[r[keep], c[keep]]


def _meet(queries: DataFrame, vectors: DataFrame, k: int, width: int) -> DataFrame:
    """Best ``k`` vectors per query within each group of vectors, as hit rows; for any number of queries.

    Vectors are dealt out into groups of bounded size, queries into parts, and each part meets each group
    in a cell of its own: with as many groups as parts, rows are copied, and hits handed on, by the square
    root of the cells. A task reads the vectors of a cell, then its queries batch by batch: one group and one batch are in
    memory, and no query passes the driver.
    """
    spark = vectors.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    groups = max(round(tasks ** 0.5), -(-vectors.count() // GROUP_VECTORS))
    parts = -(-tasks // groups)

    def dealt(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n))

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    whole = F.size("embedding") == width
    id_field = queries.schema["query_id"]
    sides = (vectors.where(whole).select(dealt("vec_id", groups).alias("_group"), all_of(parts).alias("_part"), F.col("vec_id").cast("bigint").alias("vec_id"),
                                         F.lit(None).cast(id_field.dataType).alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                                         F.lit(False).alias("asks")),
             queries.where(whole).select(all_of(groups).alias("_group"), dealt("query_id", parts).alias("_part"), F.lit(None).cast("bigint").alias("vec_id"),
                                         "query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(True).alias("asks")))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, ids = None, [], []  # the vectors of the group that is being read
        for batch in batches:
            of = batch.column("group").to_numpy(zero_copy_only=False)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            matrix = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            cuts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (asks[1:] != asks[:-1])])
            for at, end in zip(cuts, np.r_[cuts[1:], len(of)]):
                if of[at] != group:
                    group, held, ids = of[at], [], []
                if not asks[at]:
                    held.append(matrix[at:end][np.isfinite(matrix[at:end]).all(axis=1)])
                    ids.append(batch.column("vec_id").slice(at, end - at).to_numpy(zero_copy_only=False)[np.isfinite(matrix[at:end]).all(axis=1)])
                elif held:
                    held, ids = [np.concatenate(held)], [np.concatenate(ids)]
                    for r, found, scores in _best_of(matrix[at:end], held[0], ids[0], k):
                        yield pa.RecordBatch.from_arrays([batch.column("query_id").slice(at, end - at).take(pa.array(r)), pa.array(found.astype(np.int64)),
                                                          pa.array(scores)], names=["query_id", "vec_id", "score"])

    # a task is a cell, vectors before queries
    cells = sides[0].unionByName(sides[1]).withColumn("group", (F.col("_group") * parts + F.col("_part")).cast("int")).drop("_group", "_part")
    return cells.repartitionById(groups * parts, "group").sortWithinPartitions("group", "asks").mapInArrow(
        best, ST.StructType([ST.StructField("query_id", id_field.dataType), ST.StructField("vec_id", ST.LongType()), ST.StructField("score", ST.DoubleType())]))


def topk_inner_product(queries: DataFrame, vectors: DataFrame, k: int = 5, min_score: float | None = 0.3,
                       max_rows: int = MAX_QUERY_ROWS) -> DataFrame:
    """Exact flat search: the ``k`` best vectors per query, then the strict score threshold.

    ``queries(query_id, embedding)``, ``vectors(vec_id, embedding)``; gives
    ``(query_id, vec_id, score, rank)``. Rows of one ``query_id`` are one query that asks with several
    vectors: a vector found counts once, with its best score. Vectors that are null, hold nulls or
    non-finite numbers, or differ in length from the queries (all of one length) take no part; neither
    do such queries. A batch of at most ``max_rows`` queries is shipped to the vectors, which are then
    read once and never shuffled: each task scores its batches as matrix products and keeps a running
    best ``k`` per query. Of a larger batch, equal vectors are searched once; if there are still more than
    ``max_rows``, they meet groups of vectors, see ``_meet``. Either way a task
    hands on ``k`` rows per query, and those are ranked. With few queries the hits are at most queries
    times ``k``; below a million they are marked for broadcast, so that looking up their chunks does
    not shuffle the corpus. Runs a job to read the first ``max_rows`` queries.
    """
    id_type = queries.schema["query_id"].dataType
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = queries.select("query_id", "embedding").where(sound & (F.size("embedding") > 0))
    table = asked.limit(max_rows + 1).toArrow()
    ids = table.column("query_id").combine_chunks()
    flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    width = len(flat) // len(ids) if len(ids) else 1
    good = vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull()))
    if table.num_rows <= max_rows:
        hits = _scan(vectors, ids, flat.astype(np.float64).reshape(len(ids), width), k, id_type)
    else:
        # equal vectors find the same: each is searched once, and its queries share what it finds
        named = F.sha2(F.col("embedding").cast("array<double>").cast("string"), 256)
        asked = written(asked.select("query_id", "embedding", named.alias("_vector")))
        each = written(asked.groupBy(F.col("_vector").alias("query_id")).agg(F.first("embedding").alias("embedding")))
        table = each.limit(max_rows + 1).toArrow()
        if table.num_rows <= max_rows:
            flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            found = _scan(vectors, table.column("query_id").combine_chunks(), flat.astype(np.float64).reshape(table.num_rows, width), k, ST.StringType())
        else:
            found = _meet(each, good, k, width)
        best = top_n_per_key(found, ["query_id"], [F.col("score").desc(), F.col("vec_id").asc()], k).drop("rank").withColumnRenamed("query_id", "_vector")
        best = F.broadcast(best) if table.num_rows * k <= MAX_HIT_ROWS and table.num_rows <= max_rows else best
        hits = asked.select("query_id", "_vector").join(best, "_vector").drop("_vector")
    once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    top = top_n_per_key(once, ["query_id"], [F.col("score").desc(), F.col("vec_id").asc()], k)
    top = top if min_score is None else top.where(F.col("score") > min_score)
    return F.broadcast(top) if len(ids) <= max_rows and len(ids) * k <= MAX_HIT_ROWS else top


def doc_aware_retrieve(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, targets: DataFrame,
                       k: int = 10, min_score: float = 0.3) -> DataFrame:
    """Oversampled search, hard document filter, boost of filtered hits, threshold, cut to ``k``.

    ``chunks`` maps ``vec_id`` to at least ``source``; ``targets(query_id, target)``. The
    filter deliberately comes after the oversampled top-k, as specified. Hits stay in the order of the
    search: boosted scores are capped at 1, so many of them tie.
    """
    hits = topk_inner_product(queries, vectors, max(2 * k, 20), 0.2).withColumnRenamed("rank", "_search").join(chunks, "vec_id")
    filtered = filter_hits_by_doc(hits, targets)
    routed = targets.select("query_id").distinct().withColumn("_routed", F.lit(True))
    boosted = (filtered.join(routed, "query_id", "left")
               .withColumn("score", F.when(F.col("_routed"), F.least(F.lit(1.0), F.col("score") * 1.3))
                           .otherwise(F.col("score"))).drop("_routed")
               .where(F.col("score") > min_score))
    return top_n_per_key(boosted, ["query_id"], [F.col("_search").asc()], k).drop("_search")


def search_again(asked: DataFrame, answers: DataFrame, encode: Callable[[DataFrame, str], DataFrame], vectors: DataFrame,
                 chunks: DataFrame, targets: DataFrame, k: int = 10, k_again: int = 8) -> tuple[DataFrame, DataFrame]:
    """Hits of all queries, with a second search for those whose answer is weak, and the judgement of the answers.

    ``asked(query_id, text)``, ``answers(query_id, answer, steps)``: an answer is judged by
    ``rules.critique``; where its confidence is low, the shortened question is searched too, and both
    searches' hits merge by best score (ties to the search that came first, then its order), cut to
    ``k``. A query without an answer, or with an empty question, is searched once. Hits carry
    ``search`` (1 or 2), where they were found best. The queries of the second search come from a
    filter, so what is not weak is not embedded again. ``vectors`` are read by both searches: hand in
    stored ones. Of ``chunks`` every column but ``vec_id`` and ``source`` is carried along as it is.
    """
    judged = asked.join(answers, "query_id").select("query_id", rules.critique(F.col("text"), F.col("answer"), F.col("steps")).alias("_c")).select(
        "query_id", "_c.*")
    weak = judged.where((F.col("confidence") == "low") & (F.coalesce("refined_query", F.lit("")) != "")).select(
        "query_id", F.col("refined_query").alias("text"))

    def hits(rows: DataFrame, n: int, search: int) -> DataFrame:
        return doc_aware_retrieve(encode(rows, "text"), vectors, chunks, targets, n).withColumn("search", F.lit(search))

    both = hits(asked.select("query_id", "text"), k, 1).unionByName(hits(weak, k_again, 2))
    best = first_per_key(both, ["query_id", "vec_id"], [-F.col("score"), F.col("search")])
    order = [F.col("score").desc(), F.col("search"), F.col("_rank"), F.col("vec_id")]
    merged = top_n_per_key(best.withColumnRenamed("rank", "_rank"), ["query_id"], order, k).drop("_rank")
    return merged, judged


def dedup_hits(hits: DataFrame, prefix: int = 100) -> DataFrame:
    """Of hits of one query that start with the same 100 characters the best ranked stays."""
    return first_per_key(hits.withColumn("_head", F.left("text", F.lit(prefix))),
                         ["query_id", "_head"], ["rank"]).drop("_head")


def rank_by_evidence(hits: DataFrame) -> DataFrame:
    """Order hits of a query by evidence level (unknown is 7), then score."""
    w = W.partitionBy("query_id").orderBy(F.coalesce("evidence_level", F.lit(7)),
                                          F.col("score").desc(), F.col("vec_id"))
    return hits.withColumn("evidence_rank", F.row_number().over(w))


def filter_by_section(hits: DataFrame, tags: list[str]) -> DataFrame:
    """Only hits with a listed tag, unless that leaves a query fewer than two."""
    if not tags:
        return hits
    listed = F.coalesce(F.col("section_tag").isin(tags), F.lit(False))
    n = F.sum(listed.cast("int")).over(W.partitionBy("query_id"))
    return hits.withColumn("_n", n).where((F.col("_n") < 2) | listed).drop("_n")


# ---- fixed values: context and fallback wording -------------------------------------------
CONTEXT_HEAD, CONTEXT_QUERY = "## 检索上下文\n", "查询: "
CONTEXT_HITS, CONTEXT_ITEM = "\n### 检索结果 (共 %d 条)", "\n--- 结果 %d ---"
CONTEXT_OVERVIEW, CONTEXT_CONSISTENCY = "\n### 证据概览\n", "\n### 一致性评估\n"
CONTEXT_TAIL = ("\n\n## 回答要求\n1. 请基于以上检索结果回答问题\n"
                "2. 给出每个关键事实的来源引用（文献+页码+证据等级）\n"
                "3. 如有多个来源，说明证据是否一致\n4. 如检索结果不充分，明确指出不确定之处")
FALLBACK_HEAD = "## 检索结果 (FAISS 直接检索，未经过 LLM 推理)\n"
FALLBACK_TAIL = "\n> 以上为知识库直接检索结果，仅供参考。"
FALLBACK_CONNECTION = ("\n> ⚠️ AI 推理服务暂时无法连接，以下为知识库直接检索结果。"
                       "Agent 将在网络恢复后自动切换回推理模式。")
FALLBACK_AUTH = "\n> ⚠️ AI 推理服务认证失败，请联系管理员检查 API 密钥配置。以下为知识库直接检索结果。"
FALLBACK_RATE = "\n> ⚠️ AI 推理服务请求过于频繁，请稍后重试。以下为知识库直接检索结果。"
FALLBACK_OTHER = "\n> ⚠️ Agent 推理引擎暂时不可用，以下为知识库直接检索结果。详情: "
NOT_AVAILABLE = "抱歉，当前无法处理您的请求。Agent推理引擎和FAISS检索均不可用。\n错误: %s"
CHART_QUERY_SUFFIX = " 表格 图表"
# -------------------------------------------------------------------------------------------


def _ordered(value: Column, *order: str) -> Column:
    """Values of a query's hits by the given order; hits per query are bounded by k."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], value.alias("_v"))))
    return F.transform(rows, lambda r: r["_v"])


def assemble_context(hits: DataFrame, queries: DataFrame, keep: int = 10) -> DataFrame:
    """Prompt context per query: up to ten hits, strongest evidence first, with labels.

    ``queries(query_id, text[, evidence_summary, consistency_report])``; a query without hits gets a
    context of none.
    """
    level = F.coalesce("evidence_level", F.lit(7))
    head = F.concat(F.lit("["), rules.level_label(level), F.lit("] 来源: "), F.col("source"),
                    F.when(F.coalesce("section_tag", F.lit("")) != "",
                           F.concat(F.lit(", 章节: "), F.col("section_tag"))).otherwise(""))
    body = F.concat(head, F.lit("\n"), F.col("text"))
    per = hits.withColumn("_level", level).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"), F.slice(_ordered(body, "_level", "rank"), 1, keep).alias("_items"))
    items = F.flatten(F.transform(F.col("_items"), lambda x, i: F.array(F.format_string(CONTEXT_ITEM, i + 1), x)))
    q = queries.join(per, "query_id", "left")  # a query without hits gets a context that says so
    q = q.withColumn("hits", F.coalesce("hits", F.lit(0))).withColumn("_items", F.coalesce("_items", F.array().cast("array<string>")))

    def optional(name: str, title: str) -> Column:
        if name not in queries.columns:
            return F.array().cast("array<string>")
        return F.when(F.coalesce(name, F.lit("")) != "", F.array(F.concat(F.lit(title), F.col(name)))) \
            .otherwise(F.array().cast("array<string>"))

    context = F.array_join(F.concat(
        F.array(F.lit(CONTEXT_HEAD), F.concat(F.lit(CONTEXT_QUERY), queries["text"], F.lit("\n"))),
        optional("evidence_summary", CONTEXT_OVERVIEW), optional("consistency_report", CONTEXT_CONSISTENCY),
        F.array(F.format_string(CONTEXT_HITS, F.col("hits"))), items, F.array(F.lit(CONTEXT_TAIL))), "\n")
    return q.select("query_id", "hits", context.alias("context"))


def blend_rerank(hits: DataFrame, model_scores: DataFrame) -> DataFrame:
    """Blend vector score and model score (0-10) of the first ten hits, then sort all.

    Queries with five hits or fewer keep their order; a missing model score counts 0.5.
    ``model_scores(query_id, rank, model_score)``.
    """
    n = F.count(F.lit(1)).over(W.partitionBy("query_id"))
    h = hits.join(model_scores, ["query_id", "rank"], "left").withColumn("_n", n)
    blended = F.col("score") * 0.3 + F.coalesce(F.col("model_score") / 10.0, F.lit(0.5)) * 0.7
    active = (F.col("_n") > 5) & (F.col("rank") <= 10)
    h = h.withColumn("final_score", F.when(active, blended).otherwise(F.col("score")))
    w = W.partitionBy("query_id").orderBy(
        F.when(F.col("_n") > 5, -F.col("final_score")).otherwise(F.col("rank").cast("double")), "rank")
    return h.withColumn("final_rank", F.row_number().over(w)).drop("_n", "model_score")


def deep_retrieve(topics: DataFrame, encode: Callable[[DataFrame, str], DataFrame], vectors: DataFrame,
                  chunks: DataFrame, k: int = 3, keep: int = 300) -> DataFrame:
    """Three hits per aspect of a topic; ``topics(topic, aspects array<string>)``."""
    asked = topics.select("topic", F.explode("aspects").alias("aspect")).select(
        "topic", "aspect", F.concat_ws(" ", "topic", "aspect").alias("text"))
    asked = asked.withColumn("query_id", F.md5("text"))
    hits = topk_inner_product(encode(asked.select("query_id", "text").distinct(), "text"), vectors, k)
    return (hits.join(chunks, "vec_id").join(asked.select("query_id", "topic", "aspect"), "query_id")
            .select("topic", "aspect", "rank", "source", F.left("text", F.lit(keep)).alias("text")))


def chart_hits(requests: DataFrame, encode: Callable[[DataFrame, str], DataFrame], vectors: DataFrame,
               chunks: DataFrame, k: int = 5, keep: int = 500) -> DataFrame:
    """Five hits for a figure or table of a document; ``requests(query_id, doc_name, hint)``."""
    asked = requests.select("query_id", F.concat(F.col("doc_name"), F.lit(" "), F.col("hint"),
                                                 F.lit(CHART_QUERY_SUFFIX)).alias("text"))
    hits = topk_inner_product(encode(asked, "text"), vectors, k)
    return hits.join(chunks, "vec_id").select(
        "query_id", "rank", "source", F.left("text", F.lit(keep)).alias("text"))


def cross_check(hits: DataFrame) -> DataFrame:
    """Documents behind a topic's hits with their evidence label and first two passages.

    ``hits(query_id, rank, doc_name, text)``; topics with fewer than two documents are marked
    insufficient.
    """
    label = rules.evidence_label("text")
    h = hits.withColumn("_label", label)
    per = h.groupBy("query_id", "doc_name").agg(
        F.coalesce(F.min_by("_label", F.when(F.col("_label").isNotNull(), F.col("rank"))),
                   F.lit("unknown")).alias("evidence"),
        F.min("rank").alias("first_rank"),
        F.slice(_ordered(F.left("text", F.lit(300)), "rank"), 1, 2).alias("findings"))
    n = F.count(F.lit(1)).over(W.partitionBy("query_id"))
    return per.withColumn("documents", n).withColumn(
        "assessment", F.when(F.col("documents") < 2, "insufficient").otherwise("compared"))


def cross_check_levels(checked: DataFrame) -> DataFrame:
    """Documents per topic and evidence label."""
    return (checked.where(F.col("assessment") == "compared").groupBy("query_id", "evidence")
            .agg(F.count(F.lit(1)).alias("documents"), _ordered(F.col("doc_name"), "first_rank").alias("names")))


def extractive_answer(hits: DataFrame, errors: DataFrame, shown: int = 5, keep: int = 400) -> DataFrame:
    """Answer made of the first passages when no model is reachable; ``errors(query_id, error)``.

    A query without hits gets the fixed answer that nothing is available.
    """
    quoted = F.concat(F.lit("**来源 "), F.col("rank").cast("string"), F.lit("**: "), F.col("source"),
                      F.lit("\n> "), F.left("text", F.lit(keep)), F.lit("\n"))
    per = hits.where(F.col("rank") <= shown).groupBy("query_id").agg(_ordered(quoted, "rank").alias("_lines"))
    e = F.col("error")
    note = (F.when(T.contains_any(e, ["Connection", "ConnectError"]) | F.contains(F.lower(e), F.lit("timeout")),
                   FALLBACK_CONNECTION)
            .when(F.contains(F.lower(e), F.lit("auth")) | T.contains_any(e, ["401", "403"]), FALLBACK_AUTH)
            .when(F.contains(F.lower(e), F.lit("rate")) | F.contains(e, F.lit("429")), FALLBACK_RATE)
            .otherwise(F.concat(F.lit(FALLBACK_OTHER), F.left(e, F.lit(60)))))
    answer = F.array_join(F.concat(F.array(F.lit(FALLBACK_HEAD)), F.col("_lines"), F.array(note, F.lit(FALLBACK_TAIL))), "\n")
    return errors.join(per, "query_id", "left").select(
        "query_id", F.when(F.col("_lines").isNotNull(), answer).otherwise(F.format_string(NOT_AVAILABLE, e)).alias("answer"))


def numbered_sources(hits: DataFrame, preview: int = 200) -> DataFrame:
    """Reference list of an answer: number, source, rounded score, preview, image where present."""
    return hits.select("query_id", F.col("rank").alias("ref"), "source", F.round("score", 3).alias("score"),
                       F.left("text", F.lit(preview)).alias("text_preview"), "image_url",
                       F.when(F.col("image_url").isNotNull(), F.col("type")).alias("chart_type"))


def search_result_set(queries: DataFrame, hits: DataFrame, graph: DataFrame, keep: int = 500) -> DataFrame:
    """One row per query: snippets, optional graph summary and the engine that answered.

    ``graph(query_id, summary)``; snippets are at most k per query.
    """
    snippet = F.struct(F.col("rank").alias("ref"), F.col("source"), F.round("score", 3).alias("score"),
                       F.left("text", F.lit(keep)).alias("text"), T.source_doc("source").alias("doc"),
                       F.col("page_idx"), F.col("section_tag").alias("section"))
    per = hits.groupBy("query_id").agg(_ordered(snippet, "rank").alias("snippets"))
    g = graph.select("query_id", F.left("summary", F.lit(600)).alias("graph_context"))
    return queries.select("query_id").join(per, "query_id", "left").join(g, "query_id", "left").select(
        "query_id", "snippets", F.coalesce(F.size("snippets"), F.lit(0)).cast("bigint").alias("source_count"),
        "graph_context", F.when(F.col("graph_context").isNotNull(), "hybrid").otherwise("faiss").alias("engine"))


SNIPPET_TYPE = "array<struct<source:string,image_url:string,type:string,text:string>>"


def trace_sources(trace: DataFrame, keep: int = 8) -> DataFrame:
    """First eight sources named by an agent run, newest step first.

    ``trace(run_id, step, tool, result_preview)``; a preview is a JSON list of items, or an
    object holding one.
    """
    raw = F.regexp_replace("result_preview", r"\.+$", "")
    found = F.coalesce(F.from_json(raw, f"`文献证据` {SNIPPET_TYPE}, text_snippets {SNIPPET_TYPE}"))
    as_list = F.from_json(raw, SNIPPET_TYPE)
    is_list = F.startswith(F.ltrim(raw), F.lit("["))
    items = F.when(is_list, as_list).otherwise(F.coalesce(found["文献证据"], found["text_snippets"]))
    rows = (trace.where(F.col("tool").isin("search_rag", "self_reflect"))
            .select("run_id", "step", F.posexplode(items).alias("pos", "item"))
            .where(F.col("item.source").isNotNull()))
    top = top_n_per_key(rows, ["run_id"], [F.col("step").desc(), F.col("pos").asc()], keep)
    return top.select("run_id", "rank", F.col("item.source").alias("title"), F.lit("文献").alias("type"),
                      F.col("item.image_url").alias("image_url"),
                      F.when(F.col("item.image_url").isNotNull(), F.left("item.text", F.lit(200))).alias("text_preview"))


def conversation_context(turns: DataFrame, n: int = 3, keep: int = 500) -> DataFrame:
    """Last ``n`` question/answer turns before the current question of each conversation.

    ``turns(conv_id, turn, question, answer)``; the newest turn is the current question.
    """
    recent = top_n_per_key(turns, ["conv_id"], [F.col("turn").desc()], n + 1)
    message = F.when(F.col("rank") == 1, F.array(F.col("question"))).otherwise(
        F.array_compact(F.array("question", F.left("answer", F.lit(keep)))))
    return recent.groupBy("conv_id").agg(
        F.max("turn").alias("current_turn"), F.flatten(_ordered(message, "turn")).alias("messages"))


TEXTS_AT_ONCE = 2_048  # texts whose words are told apart together


def _word_counts(texts: pa.Array, dim: int) -> np.ndarray:
    """Words of every text, each counted in the place that its hash picks; equal words are hashed once."""
    words = pc.utf8_split_whitespace(texts)  # the white space of ``text.SPACE``; may leave empty words at the ends
    each = words.flatten().dictionary_encode()
    names = each.dictionary.cast(pa.binary()).to_pylist()
    heads = np.frombuffer(b"".join(md5(name).digest()[:3] for name in names), dtype=np.uint8).reshape(-1, 3)
    places = heads @ np.array([65_536, 256, 1]) % dim
    places[np.fromiter(map(len, names), dtype=np.int64, count=len(names)) == 0] = dim  # a place of their own, cut off
    rows = np.repeat(np.arange(len(texts)) * (dim + 1), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    return np.bincount(rows + places[each.indices.to_numpy()], minlength=len(texts) * (dim + 1)).reshape(-1, dim + 1)[:, :dim]


def hashed_terms(text: Column | str, dim: int = 64) -> Column:
    """L2-normalised word counts, each word counted in one of ``dim`` places that its hash picks.

    A stand-in for an embedding model without a model. Null and empty texts give zeros.
    """
    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [_word_counts(texts.slice(at, TEXTS_AT_ONCE), dim) for at in range(0, len(texts), TEXTS_AT_ONCE)]
            counts = np.concatenate([np.empty((0, dim)), *parts])
            norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            units = counts / np.where(norm == 0, 1.0, norm)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dim, pa.int32()), pa.array(units.ravel()))

    return embed(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


def batch_embed(df: DataFrame, text: str, encoder: Callable[[pd.Series], np.ndarray] | None = None,
                batch: int = 16, out: str = "embedding", dim: int = 64) -> DataFrame:
    """Add L2-normalised vectors from a user encoder called on batches of 16 texts.

    Without an encoder they are hashed word counts of ``dim`` places.
    """
    if encoder is None:
        return df.withColumn(out, hashed_terms(text, dim))

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            done = []
            for at in range(0, len(s), batch):
                m = np.asarray(encoder(s.iloc[at:at + batch]), dtype=np.float64)
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                done.extend(m / np.where(norm == 0, 1.0, norm))
            yield pd.Series(done, dtype=object)

    return df.withColumn(out, embed(F.col(text)))
