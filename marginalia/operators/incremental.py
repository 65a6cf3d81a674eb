"""Keeping a knowledge base current: diffs by content hash, ids, removal and replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators import ingest
from marginalia.operators.keyed import first_per_key, global_row_number
from marginalia.session import forget, free_shuffles, written


def diff_document(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per document and content hash: copies kept, stale and added.

    Both sides are counted in one aggregate over their union, so the plan has a single shuffle,
    copies combine before it, and no join can fan out. One stored copy matches one new copy;
    further stored copies are stale, further new ones duplicates.
    """
    def side(df: DataFrame, o: int, n: int) -> DataFrame:
        return df.select("doc_name", "content_md5", F.lit(o).alias("_o"), F.lit(n).alias("_n"))

    both = side(old, 1, 0).unionByName(side(new, 0, 1))
    g = both.groupBy("doc_name", "content_md5").agg(F.sum("_o").alias("old_copies"),
                                                    F.sum("_n").alias("new_copies"))
    kept = F.when((F.col("old_copies") > 0) & (F.col("new_copies") > 0), 1).otherwise(0).cast("bigint")
    return g.select("doc_name", "content_md5", kept.alias("kept"),
                    (F.col("old_copies") - kept).alias("stale"),
                    F.when((F.col("old_copies") == 0) & (F.col("new_copies") > 0), 1).otherwise(0)
                    .cast("bigint").alias("added"))


def document_hash(items: DataFrame) -> DataFrame:
    """One hash per document over its searchable texts, joined in item order.

    A document is what one parsed file held, so its text fits a cell like the file did.
    """
    kinds = items.where(F.col("type").isin("text", "image", "chart", "table"))
    ordered = F.array_sort(F.collect_list(F.struct("item_idx", F.coalesce("text", F.lit("")).alias("t"))))
    return kinds.groupBy("doc_name").agg(
        F.md5(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n")).alias("doc_md5"))


def skip_known_documents(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose hash is neither stored nor carried by an earlier one of the batch.

    ``docs(doc_name, doc_md5, ...)``, ``known(doc_md5)``.
    """
    fresh = docs.join(known.select("doc_md5").distinct(), "doc_md5", "left_anti")
    return first_per_key(fresh, ["doc_md5"], ["doc_name"])


def assign_vector_ids(chunks: DataFrame, next_id: int | Column = 0) -> DataFrame:
    """Contiguous ids from ``next_id`` on in (document, position) order; ids are never reused.

    Runs one job: see ``global_row_number``.
    """
    return global_row_number(chunks, ["doc_name", "chunk_idx"], next_id, "vec_id")


def next_vector_id(vectors: DataFrame) -> DataFrame:
    """One row: the id after the largest stored one."""
    return vectors.agg((F.coalesce(F.max("vec_id"), F.lit(-1)) + 1).alias("next_id"))


def remove_documents(table: DataFrame, gone: DataFrame, key: str = "doc_name") -> DataFrame:
    """Rows of the named documents dropped, every other row and id unchanged."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


#: Columns that say where a chunk stands in its document.
PLACE = ("chunk_idx", "page_idx", "source")


def upsert_changes(stored: DataFrame, items: DataFrame, analysis: str | None = None,
                   known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What (re-)ingesting documents changes, as narrow rows, and the chunks that the items offer; see ``offered_changes``."""
    return offered_changes(stored, ingest.offered_chunks(items, analysis), known)


def offered_changes(stored: DataFrame, offered: DataFrame, known: DataFrame | None = None,
                    paths: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What (re-)ingesting documents changes, as narrow rows, and the chunks that their items offer.

    ``offered`` holds a row per item, see ``ingest.offered_chunks``.
    Rows of ``(kind, doc_name, content_md5, chunk_idx, page_idx, source, stays, kept, stale)``:
    ``change`` for a stored hash of the documents whose chunk goes (``stays`` null) or moves (the
    stored chunk at ``stays`` takes the place given), ``add`` for a chunk to be added if it passes
    the gate, ``document`` with the counts of each document. Chunks that stay as they are give no
    row. Texts take no part: places are aggregated per (document, hash) on either side and meet in
    one join, new hashes and all stored ones in one aggregate per hash; all combine before their
    shuffle, so neither a document nor a hash with a third of the rows lands in one task.

    Runs three jobs, one over the items, whose hashes and places are written to the shared folder, and
    two over narrow rows only; their results are written too, so that its size is known where it is
    joined, and few changes are sent to the texts instead of the texts to them. ``paths`` gets the
    result's folder, for ``session.forget``, and where it is given, shuffles of finished jobs are dropped; the
    other folders are deleted here.
    """
    at, own = F.struct(*PLACE), []
    new = written(offered.groupBy("doc_name", "content_md5").agg(F.min_by(at, "chunk_idx").alias("now")), own)
    candidates = offered.where(F.col("text").isNotNull()).withColumn("section_tag", F.lit(None).cast("string"))
    touched = new.select("doc_name").distinct()
    near = stored.join(touched, "doc_name", "left_semi")
    far = stored.join(touched, "doc_name", "left_anti").select("content_md5")
    was = near.groupBy("doc_name", "content_md5").agg(F.min_by(at, "chunk_idx").alias("was"), F.count(F.lit(1)).alias("copies"))
    # items that are not searchable have no hash: they only tell that their document is touched
    # written, as four steps read it
    g = written(was.join(new.where(F.col("content_md5").isNotNull()), ["doc_name", "content_md5"], "full").withColumn(
        "copies", F.coalesce("copies", F.lit(0)).cast("bigint")), own)
    if paths is not None:
        free_shuffles(g.sparkSession)
    was, now = F.col("was"), F.col("now")
    both = was.isNotNull() & now.isNotNull()
    hashes = far.unionByName(g.where(both).select("content_md5"))
    if known is not None:
        hashes = hashes.unionByName(known.select("content_md5"))

    def rows(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
        empty = {"content_md5": "string", "chunk_idx": "bigint", "page_idx": "bigint", "source": "string", "stays": "bigint",
                 "kept": "bigint", "stale": "bigint"}
        return df.select(F.lit(kind).alias("kind"), "doc_name", *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in empty.items()])

    changed = rows(g.where(was.isNotNull() & (now.isNull() | (F.col("copies") > 1) | ~was.eqNullSafe(now))), "change",
                   content_md5=F.col("content_md5"), stays=F.when(now.isNotNull(), was["chunk_idx"]), **{c: now[c] for c in PLACE})
    offer = F.struct(F.lit(1).alias("k"), F.col("doc_name").alias("doc_name"), now["chunk_idx"].alias("chunk_idx"))
    taken = F.struct(F.lit(0).alias("k"), F.lit("").alias("doc_name"), F.lit(0).cast("bigint").alias("chunk_idx"))
    won = g.where(was.isNull()).select("content_md5", offer.alias("_o")).unionByName(
        hashes.select("content_md5", taken.alias("_o"))).groupBy("content_md5").agg(F.min("_o").alias("_o")).where(F.col("_o.k") == 1)
    added = rows(won.select("content_md5", "_o.doc_name", "_o.chunk_idx"), "add", content_md5=F.col("content_md5"), chunk_idx=F.col("chunk_idx"))
    per = g.groupBy("doc_name").agg(F.count_if(both).alias("kept"), (F.sum("copies") - F.count_if(both)).alias("stale"))
    counts = rows(per, "document", kept=F.col("kept"), stale=F.col("stale"))
    changes = written(changed.unionByName(added).unionByName(counts), paths)
    forget(changes.sparkSession, own)
    return changes, candidates


def changed_rows(stored: DataFrame, changes: DataFrame, only: bool = False) -> DataFrame:
    """The stored rows after the changes: gone ones left out, moved ones at their new place.

    ``only`` gives just those that the changes name.
    """
    keys = ["doc_name", "content_md5"]
    named = changes.where(F.col("kind") == "change").select(*keys, F.struct("stays", *PLACE).alias("_new"))
    new = F.col("_new")
    stays = new["stays"] == F.col("chunk_idx")
    met = stored.join(named, keys, "inner" if only else "left").where(stays if only else new.isNull() | stays)
    return met.select(*[F.when(new.isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in PLACE else F.col(c) for c in stored.columns])


def added_rows(candidates: DataFrame, changes: DataFrame) -> DataFrame:
    """The chunks to be added, with their texts: gated and labelled."""
    chosen = changes.where(F.col("kind") == "add").select("doc_name", "content_md5", "chunk_idx")
    return ingest.tag_sections(ingest.quality_gate(candidates.join(chosen, ["doc_name", "content_md5", "chunk_idx"], "left_semi")))


def upsert_documents(stored: DataFrame, items: DataFrame, analysis: str | None = None,
                     known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New state of the chunk table after (re-)ingesting documents, and counts per document.

    Stored chunks of the given documents that no longer occur are dropped, kept ones take position,
    page and source from the new version; new ones pass the gate, must be unknown to the whole
    remaining table, are labelled and appended. Documents not in ``items`` are untouched. When
    ``stored`` is only a part of the table, ``known(content_md5)`` brings the hashes of the rest.
    Runs one job over narrow rows, see ``upsert_changes``; what does not change is not shuffled.
    """
    changes, candidates = upsert_changes(stored, items, analysis, known)
    fresh = added_rows(candidates, changes)
    state = changed_rows(stored, changes).unionByName(fresh.select(*stored.columns))
    counts = changes.where(F.col("kind") == "document").select("doc_name", "kept", "stale").join(
        fresh.groupBy("doc_name").agg(F.count(F.lit(1)).alias("added")), "doc_name", "left")
    return state, counts.withColumn("added", F.coalesce("added", F.lit(0)).cast("bigint"))
