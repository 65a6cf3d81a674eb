"""Joins between chunks, documents, files, queries and notes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from marginalia.functions import text as T
from marginalia.functions.rules import upload_outcome
from marginalia.operators.keyed import first_per_key
from marginalia.session import written

MAX_LITERAL_TERMS = 2_000


def parent_page_context(hits: DataFrame, page_texts: DataFrame, keep: int = 3000) -> DataFrame:
    """Page text behind each distinct (query, document, page) of the hits; unknown pages drop out."""
    wanted = hits.select("query_id", "doc_name", "page_idx").where(F.col("page_idx").isNotNull()).distinct()
    pages = page_texts.where(F.col("text") != "").select(
        "doc_name", "page_idx", F.left("text", F.lit(keep)).alias("full_text"))
    return wanted.join(pages, ["doc_name", "page_idx"])


def hits_to_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk rows of vector hits; ids without a chunk drop out."""
    return hits.join(chunks, "vec_id")


#: Terms of up to as many characters are looked up whole, longer ones by pieces of this size.
GRAM = 16
#: Characters of terms, and 16 a term, that may be broadcast.
SHIPPED = 8_000_000
#: Rules that every text meets first in ``classify_by_table``.
EARLY_RULES = 20_000
_BLOCK = 128
#: Characters of texts searched at once in a task; bits of the filter of terms, as powers of two.
CHARS, FILTER_BITS = 1 << 17, (16, 27)


def _joined(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """Texts in one string, their lengths, and its code points."""
    whole = "".join(texts)
    return whole, np.array([len(t) for t in texts], np.int64), np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hashes(points: np.ndarray, lengths: list[int], bits: int):
    """``(n, hashes, places)`` for each length: of the pieces of ``n`` characters that begin at each character, and where the filter keeps them."""
    h = np.zeros(len(points), np.uint64)
    for n in range(1, min(lengths[-1], len(points)) + 1):
        h = h[:len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1:]
        if n in lengths:
            z = (h ^ (h >> np.uint64(32)) ^ np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            yield n, z, (z >> np.uint64(64 - bits)).astype(np.int64)


def _filter(terms: DataFrame, lengths: list[int], column: str) -> tuple[int, object]:
    """``(bits, shipped)``: a bitmap of bounded size with a bit set for each term, however many there are."""
    low, high = FILTER_BITS
    bits = min(high, max(low, math.ceil(math.log2(64 * terms.count() + 1))))

    @F.pandas_udf("long")
    def place(some: pd.Series) -> pd.Series:
        _, sizes, points = _joined(some.tolist())
        starts, out = np.cumsum(sizes) - sizes, np.zeros(len(some), np.int64)
        for n, _, places in _hashes(points, lengths, bits):
            out[sizes == n] = places[starts[sizes == n]]
        return pd.Series(out)

    at = (place(column) + 1).alias("p")
    rows = terms.select(at).groupBy(F.expr("bitmap_bucket_number(p)").alias("block")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("set"))
    whole = np.zeros(max(1 << bits >> 3, 4096), np.uint8)
    for r in rows.collect():  # a row of 4 KB per 32768 bits
        whole[(r.block - 1) * 4096:r.block * 4096] = np.frombuffer(r.set, np.uint8)
    return bits, terms.sparkSession.sparkContext.broadcast(whole.tobytes())


def _distinct(at: np.ndarray, n: int, hashes: np.ndarray, row: np.ndarray, points: np.ndarray) -> np.ndarray:
    """One place each of the different pieces that begin at some places of a row; hashes bring equal ones together, characters decide."""
    key = hashes[at] + row[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(key)
    at, key = at[order], key[order]
    new = np.append(True, key[1:] != key[:-1])[:len(at)]
    first = at[new][np.cumsum(new) - 1]
    same = row[at] == row[first]
    for j in range(n):
        same &= points[at + j] == points[first + j]
    if same.all():
        return at[new]
    return np.array(list({(int(row[i]), points[i:i + n].tobytes()): i for i in at.tolist()}.values()), np.int64)


def _pieces_kept(texts: list[str], lengths: list[int], bits: int, marks: np.ndarray) -> pa.ListArray:
    """Of each text the distinct pieces of these lengths that the filter lets through."""
    whole, sizes, points = _joined(texts)
    row, room = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))
    starts, wide = [], []
    for n, hashes, places in _hashes(points, lengths, bits):
        at = np.flatnonzero((marks[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool) & (room[:len(places)] >= n))
        starts.append(_distinct(at, n, hashes, row, points))
        wide.append(np.full(len(starts[-1]), n))
    at, n = np.concatenate(starts or [np.zeros(0, np.int64)]), np.concatenate(wide or [np.zeros(0, np.int64)])
    order = np.argsort(row[at], kind="stable")
    at, n = at[order], n[order]
    # the pieces as one run of bytes: where each character begins, and so each piece
    begins = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
    low, long = begins[at], begins[at + n] - begins[at]
    ends = np.concatenate([[0], np.cumsum(long)])
    raw = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)[np.repeat(low - ends[:-1], long) + np.arange(ends[-1])]
    pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=len(texts)))]), pa.int32()), pieces)


def _pieces(texts: DataFrame, columns: list[str], text: str, terms: DataFrame, lengths: list[int], out: str) -> DataFrame:
    """``(*columns, out)``: a row's distinct pieces of these lengths that are terms, and a few that are not; to be joined with the terms.

    All pieces of all texts are far more than those that meet a term, so a filter of the terms is
    shipped to the texts, and only what it lets through becomes rows.
    """
    bits, shipped = _filter(terms, lengths, out)

    def search(batches):
        marks = np.frombuffer(shipped.value, np.uint8)

        def rows(batch, places, found):
            arrays = [batch.column(j).take(pa.array(places, pa.int64())) for j in range(len(columns))]
            return pa.RecordBatch.from_arrays([*arrays, found], names=[*columns, "_pieces"])

        for batch in batches:
            held, places, size = [], [], 0
            for i, t in enumerate(batch.column(len(columns)).to_pylist()):
                if t and len(t) > CHARS:
                    cuts = [t[a:a + CHARS + GRAM - 1] for a in range(0, len(t), CHARS)]
                    found = pa.concat_arrays([_pieces_kept([c], lengths, bits, marks).flatten() for c in cuts]).unique()
                    yield rows(batch, [i], pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found))
                elif t:
                    held.append(t)
                    places.append(i)
                    size += len(t)
                if size > CHARS:
                    yield rows(batch, places, _pieces_kept(held, lengths, bits, marks))
                    held, places, size = [], [], 0
            if held:
                yield rows(batch, places, _pieces_kept(held, lengths, bits, marks))

    read = texts.select(*columns, F.col(text).alias("_searched"))
    schema = ST.StructType([*read.schema.fields[:-1], ST.StructField("_pieces", ST.ArrayType(ST.StringType()))])
    return read.mapInArrow(search, schema).select(*columns, F.explode("_pieces").alias(out))


def _grams(text: Column, n: int) -> Column:
    """All distinct pieces of ``n`` characters of a term; none of a shorter one. Cut from blocks, as finding a place counts from the start."""
    def cut(blocks: Column) -> Column:
        wide = F.transform(blocks, lambda b, i: F.concat(b, F.left(F.coalesce(F.get(blocks, i + 1), F.lit("")), F.lit(n - 1))))
        return F.flatten(F.transform(wide, lambda w: F.transform(
            F.when(F.length(w) >= n, F.sequence(F.lit(1), F.length(w) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(w, i, n))))

    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _BLOCK), F.lit(0))
    return F.array_distinct(F.transform(F.array(blocks), cut)[0])  # a list of one binds the blocks


def _sided(small: DataFrame, text: str) -> DataFrame:
    """A written table for a join with exploded pieces: broadcast when small, else sort-merge.

    Left to Spark, the pieces would be broadcast: their estimated size is that of the texts or less.
    """
    size = small.agg(F.sum(F.length(text) + 16)).first()[0] or 0
    return F.broadcast(small) if size <= SHIPPED else small.hint("merge")


def _met(texts: DataFrame, terms: DataFrame, keys: list[str], keep: list[str], text: str) -> DataFrame:
    """``(*keys, *keep, *terms)`` for every row of ``texts`` and every row of ``terms(_term, ...)`` that its text contains.

    A term of up to ``GRAM`` characters is a piece of the texts that contain it: one equi join gives
    exactly the result. A longer one is looked up by the piece of it that fewest rows have, and
    what it meets is searched. Empty and null terms and texts match nothing.
    """
    terms = written(terms.where(F.length("_term") > 0))
    lengths = sorted(r[0] for r in terms.select(F.least(F.length("_term"), F.lit(GRAM + 1))).distinct().collect())  # at most GRAM + 1 numbers
    columns = [*keys, *keep, *terms.columns]
    out = None
    if short := [n for n in lengths if n <= GRAM]:
        few = terms.where(F.length("_term") <= GRAM)
        out = _pieces(texts, [*keys, *keep], text, few, short, "_term").join(_sided(few, "_term"), "_term").select(columns)
    if lengths and lengths[-1] > GRAM:
        long = terms.where(F.length("_term") > GRAM)
        wanted = written(long.select("_term").distinct().select("_term", F.explode(_grams(F.col("_term"), GRAM)).alias("_gram")))
        grams = written(wanted.select("_gram").distinct())
        near = written(_pieces(texts, keys, text, grams, [GRAM], "_gram").join(_sided(grams, "_gram"), "_gram", "left_semi"))
        seen = near.groupBy("_gram").agg(F.count(F.lit(1)).alias("_rows"))
        keyed = written(wanted.join(seen.hint("merge"), "_gram").groupBy("_term").agg(F.min_by("_gram", F.struct("_rows", "_gram")).alias("_gram")))
        offered = near.join(_sided(keyed, "_term"), "_gram").drop("_gram")
        if text not in keys:
            offered = offered.join(texts.select(*keys, *keep, text).hint("merge"), keys)
        found = offered.where(F.contains(text, F.col("_term"))).join(_sided(long, "_term"), "_term").select(columns)
        out = found if out is None else out.unionByName(found)
    return texts.join(terms, F.lit(False)).select(columns) if out is None else out


def containments(stems: DataFrame, names: DataFrame) -> DataFrame:
    """``(_stem, _name)`` of every distinct name that contains a distinct stem; empty stems match nothing.

    Names are cut into pieces, as many of each length as a name is long; see ``_met``.
    """
    found = _met(names.select("_name").distinct(), stems.select(F.col("_stem").alias("_term")).distinct(), ["_name"], [], "_name")
    return found.select(F.col("_term").alias("_stem"), "_name")


def match_terms(texts: DataFrame, terms: DataFrame, keys: list[str], text: str = "text", term: str = "term") -> DataFrame:
    """``(*keys, term)`` for every row of ``texts`` and every distinct term that its text contains; for any number of terms.

    Texts are cut into pieces of the lengths that terms have, up to ``GRAM`` characters; see ``_met``.
    ``keys`` identify a row; terms and texts are compared as they are; empty and null ones match
    nothing. The terms, and the pieces that long ones share with texts, are written to the shared folder.
    """
    words = terms.select(F.col(term).alias("_term")).distinct()
    return _met(texts.select(*keys, F.col(text).alias("_text")), words, keys, [], "_text").withColumnRenamed("_term", term)


def classify_by_table(rows: DataFrame, rules: DataFrame, keys: list[str], text: str = "text", default: str | None = None,
                      prefix: int | None = None, fold_keywords: bool = True, out: str = "label") -> DataFrame:
    """Like ``rules.classify`` with the rules as rows ``(place, label, keyword)``, for any number of keywords.

    Adds the label of the rule with the smallest place that has a keyword inside the lower-cased
    (prefix of the) text, else ``default``; of equal places the smaller label. ``keys`` identify a row.
    The first ``EARLY_RULES`` rules meet all texts; a text that has one of them needs no later one, so
    only the others meet the rest.
    """
    low = F.lower(F.left(text, F.lit(prefix)) if prefix else F.col(text))
    known = rules.select((F.lower("keyword") if fold_keywords else F.col("keyword")).alias("_term"), F.struct("place", "label").alias("_rule"))
    # a keyword of several rules counts for the first
    first = written(known.where(F.length("_term") > 0).groupBy("_term").agg(F.min("_rule").alias("_rule")))
    early = written(first.orderBy("_rule", "_term").limit(EARLY_RULES))
    texts = rows.select(*keys, low.alias("_low"))

    def best(some: DataFrame, of: DataFrame) -> DataFrame:
        return written(_met(some, of, keys, [], "_low").groupBy(*keys).agg(F.min("_rule").alias("_rule")))

    sooner = best(texts, early)
    later = best(texts.join(sooner.select(keys), keys, "left_anti"), first.join(early.select("_term"), "_term", "left_anti"))
    label = sooner.unionByName(later).select(*keys, F.col("_rule.label").alias("_label"))
    return rows.join(label, keys, "left").withColumn(out, F.coalesce("_label", F.lit(default).cast("string"))).drop("_label")


def match_files(files: DataFrame, docs: DataFrame, name: str = "file_name", doc: str = "doc_name") -> DataFrame:
    """Files whose stem equals or occurs inside a document name."""
    stems = files.withColumn("_stem", F.replace(F.col(name), F.lit(".pdf"), F.lit("")))
    found = containments(stems, docs.select(F.col(doc).alias("_name"))).select("_stem").distinct()
    hit = stems.join(found, "_stem", "left_semi").select(name).distinct().withColumn("_hit", F.lit(True))
    return (files.join(hit, name, "left")
            .withColumn("status", F.when(F.col("_hit"), "indexed").otherwise("uploaded")).drop("_hit"))


def filter_hits_by_doc(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Hits whose source contains, or is contained in, a target document of their query.

    ``targets(query_id, target)``; a query without targets keeps all its hits. Joined on the
    query, so only the few targets of one query meet its top-k hits.
    """
    lists = targets.groupBy("query_id").agg(F.collect_set("target").alias("_targets"))
    fits = F.exists("_targets", lambda t: F.contains(F.col("source"), t) | F.contains(t, F.col("source")))
    return hits.join(lists, "query_id", "left").where(F.col("_targets").isNull() | fits).drop("_targets")


def route_queries(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents a model routed each query to: ``doc;doc;...`` cut to the known ones.

    Queries with no known document get no row, which means no filter. With a single-document
    knowledge base every query maps to it.
    """
    named = (answers.select("query_id", F.explode(F.split("answer", ";")).alias("target"))
             .select("query_id", T.strip("target").alias("target")).distinct())
    known = docs.select(F.col("doc_name").alias("target")).distinct()
    routed = named.join(known, "target", "left_semi").select("query_id", "target")
    only = known.agg(F.count(F.lit(1)).alias("_n"), F.first("target").alias("_only"))
    single = only.where(F.col("_n") == 1)
    forced = answers.select("query_id").distinct().withColumn("_j", F.lit(1)).join(
        F.broadcast(single.withColumn("_j", F.lit(1))), "_j").select("query_id", F.col("_only").alias("target"))
    return routed.unionByName(forced).distinct()


def article_detail(articles: DataFrame, segments: DataFrame, figures: DataFrame) -> DataFrame:
    """Articles with their segments and figures as rows ``(…, kind, sequence, content)``.

    Children stay rows in (kind, sequence) order instead of being gathered per article, so an
    article with a third of all segments is just more rows; an article without children has one
    row with a null kind.
    """
    children = segments.select("article_id", F.lit("segment").alias("kind"), "sequence", "content").unionByName(
        figures.select("article_id", F.lit("figure").alias("kind"), "sequence", F.col("caption").alias("content")))
    return articles.join(children, "article_id", "left")


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows without a parent."""
    ids = parents.select(F.col(parent_key or key).alias(key)).distinct()
    return children.join(ids, key, "left_anti")


def reconcile(counts: dict[str, DataFrame], checks: list[tuple[str, str, str, str]]) -> DataFrame:
    """PASS/FAIL rows comparing table counts.

    ``checks`` is ``(name, left, op, right)`` with ``op`` one of ``==``, ``>=``, ``>``; each
    table is counted once and the counts meet in a single one-row aggregate.
    """
    tagged = None
    for name, df in counts.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    row = tagged.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in counts])
    ops = {"==": lambda a, b: a == b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b}

    def value(x: str) -> Column:
        return F.col(x) if x in counts else F.lit(int(x)).cast("bigint")

    rows = F.array(*[F.struct(F.lit(n).alias("check"), value(a).alias("left_count"),
                              value(b).alias("right_count"),
                              F.when(ops[op](value(a), value(b)), "PASS").otherwise("FAIL").alias("verdict"))
                     for n, a, op, b in checks])
    return row.select(F.inline(rows))


def node_neighborhood(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges incident to the given nodes with the node at the other end.

    Two equi joins instead of one OR join; a hub's edges are only filtered, never gathered.
    """
    wanted = ids.select(F.col("id").alias("_id")).distinct()
    out = edges.join(wanted, F.col("source") == F.col("_id")).select(
        F.col("_id").alias("node"), F.lit("out").alias("direction"), F.col("target").alias("neighbor"), "weight")
    inc = edges.join(wanted, F.col("target") == F.col("_id")).select(
        F.col("_id").alias("node"), F.lit("in").alias("direction"), F.col("source").alias("neighbor"), "weight")
    return out.unionByName(inc)


def note_links(notes: DataFrame) -> DataFrame:
    """``(id, link)`` rows, one per distinct target of a note, lower-cased."""
    return notes.select("id", F.explode(T.wiki_links("content")).alias("link")).select(
        "id", F.lower("link").alias("link")).distinct()


def wiki_edges(notes: DataFrame) -> DataFrame:
    """Undirected note-to-note edges; of notes sharing a title the last one is the target."""
    by_title = notes.groupBy(F.lower("title").alias("link")).agg(F.max("id").alias("target"))
    linked = note_links(notes).join(by_title, "link").where(F.col("id") != F.col("target"))
    return linked.select(F.least("id", "target").alias("a"), F.greatest("id", "target").alias("b")).distinct()


def wiki_graph(notes: DataFrame) -> DataFrame:
    """Every note with the number of notes it is connected to."""
    e = wiki_edges(notes)
    ends = e.select(F.explode(F.array("a", "b")).alias("id"))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("link_count"))
    return notes.select("id", "title").join(degree, "id", "left").withColumn(
        "link_count", F.coalesce("link_count", F.lit(0)).cast("bigint"))


def backlinks(notes: DataFrame, titles: DataFrame) -> DataFrame:
    """``(title, id)``: the notes that link to each title, case ignored."""
    t = titles.select("title", F.lower("title").alias("link")).distinct()
    return note_links(notes).join(t, "link").select("title", "id").distinct()


def induced_subgraph(nodes: DataFrame, edges: DataFrame, search: str = "", group: str = "") -> DataFrame:
    """Edges whose two ends both match the label search and group filter."""
    active = nodes
    if search.strip():
        active = active.where(F.contains(F.lower("label"), F.lit(search.strip().lower())))
    if group:
        active = active.where(F.col("grp") == group)
    ids = active.select(F.col("id").alias("_id"))
    return (edges.join(ids, F.col("source") == F.col("_id"), "left_semi")
            .join(ids, F.col("target") == F.col("_id"), "left_semi"))


def topic_evidence(evidence: DataFrame, topics: list[str] | DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Documents that mention a topic in their PICO parts or findings, one row per match.

    ``evidence(doc_name, doc_title, evidence_level, pico map, findings array)``, a row per document.
    A short list of topics is tested inside the row, so only matches are ever emitted; longer lists,
    and topics given as rows ``(topic)``, are looked up by pieces of the documents, see ``_met``.
    The empty topic is in every document. ``keep`` names the columns to carry besides ``doc_name``, else all are.
    """
    carried = evidence.columns if keep is None else ["doc_name", *keep]
    hay = F.lower(F.concat(F.to_json("pico"), F.lit("\n"), F.array_join("findings", " ")))
    if not isinstance(topics, DataFrame) and len(topics) <= MAX_LITERAL_TERMS:
        terms = F.array(*[F.lit(t) for t in topics]).cast("array<string>")
        found = F.explode(F.filter(terms, lambda t: F.contains(F.col("_hay"), F.lower(t))))
        return evidence.withColumn("_hay", hay).withColumn("topic", found).select(*carried, "topic")
    if not isinstance(topics, DataFrame):
        topics = evidence.sparkSession.createDataFrame([(t,) for t in topics], "topic string")
    asked = topics.select("topic", F.lower("topic").alias("_term"))
    rest = [c for c in carried if c != "doc_name"]
    met = _met(evidence.withColumn("_hay", hay), asked, ["doc_name"], rest, "_hay")
    whole = evidence.withColumn("_term", F.lit("")).join(asked.where(F.col("_term") == ""), "_term")
    return met.select(*carried, "topic").unionByName(whole.select(*carried, "topic"))


def best_topic_evidence(matches: DataFrame) -> DataFrame:
    """The strongest document per topic."""
    return first_per_key(matches, ["topic"], ["evidence_level", "doc_name"])


def expand_query_terms(queries: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """The query itself plus one row per synonym of each known term in it."""
    table = F.array(*[F.struct(F.lit(k).alias("term"), F.array(*[F.lit(s) for s in v]).alias("also"))
                      for k, v in synonyms.items()])
    found = F.filter(table, lambda e: F.contains(F.col("text"), e["term"]))
    extra = F.flatten(F.transform(found, lambda e: e["also"]))
    return queries.select("query_id", F.explode(F.array_distinct(
        F.concat(F.array("text"), extra))).alias("search_text"))


# ---- fixed values: terms searched together ------------------------------------------------
MESH_SYNONYMS = {
    "主动脉夹层": ["aortic dissection", "Stanford type B", "TBAD"],
    "腔内修复": ["TEVAR", "endovascular repair", "thoracic endovascular"],
    "高血压": ["hypertension", "antihypertensive", "blood pressure management"],
    "心肌梗死": ["myocardial infarction", "MI", "STEMI", "NSTEMI"],
    "卒中": ["stroke", "cerebrovascular", "CVA", "TIA"],
    "生存率": ["survival", "mortality", "prognosis", "Kaplan-Meier"],
}
# -------------------------------------------------------------------------------------------


def classify_uploads(tasks: DataFrame) -> DataFrame:
    """Outcome of every upload given the other finished tasks with its content or its name.

    The peers are pre-aggregated per hash and per name (count, and the first two finished tasks
    to exclude the task itself), so a name shared by a third of the rows stays one row.
    """
    done = tasks.where(F.col("status") == "done")
    order = F.struct("created_at", "task_uuid")
    by_md5 = done.where(F.col("file_md5").isNotNull()).groupBy("file_md5").agg(
        F.count(F.lit(1)).alias("_m"))
    first = done.groupBy("filename").agg(
        F.count(F.lit(1)).alias("_k"), F.min_by(F.struct("task_uuid", "file_md5"), order).alias("_f1"))
    second = (done.join(first.select("filename", F.col("_f1.task_uuid").alias("_skip")), "filename")
              .where(F.col("task_uuid") != F.col("_skip"))
              .groupBy("filename").agg(F.min_by(F.struct("task_uuid", "file_md5"), order).alias("_f2")))
    t = tasks.join(by_md5, "file_md5", "left").join(first, "filename", "left").join(second, "filename", "left")
    self_done = (F.col("status") == "done").cast("bigint")
    n_md5 = F.when(F.col("file_md5").isNull(), 0).otherwise(F.coalesce("_m", F.lit(0)) - self_done)
    n_name = F.coalesce("_k", F.lit(0)) - self_done
    peer = F.when(F.col("_f1.task_uuid") == F.col("task_uuid"), F.col("_f2.file_md5")).otherwise(F.col("_f1.file_md5"))
    return t.withColumn("outcome", upload_outcome(
        F.col("status"), F.col("chunks_added"), F.col("is_update"), n_md5, n_name, peer, F.col("file_md5"))) \
        .drop("_m", "_k", "_f1", "_f2")
