"""Importance resampling towards a target corpus: array-scored weights, Gumbel scores, distributed quickselect.

A document weighs as much as its features are likelier in the target texts than in the corpus; one
uniform number per id turns weights into scores whose highest ones are a draw without replacement.
The k-th highest score is found by exact counts around random pivots, so only winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import query, small_batches, table, written
from marginalia.operators.keyed import global_row_number

BUCKETS = 10_000
#: Longest run of words that is a feature.
MOST = 1
SEED = 2024
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20
PERCENT = 10
#: Pivot keys of a round of the selection; as many rows come to the driver.
PIVOTS = 32
#: Bytes of a text that stand in memory word by word at a time.
PIECE = 1 << 20

#: A-Z lower-cased; what is neither digit, letter nor part of a code point above 127 parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _words(text: bytes, piece: int) -> Iterator[list[bytes]]:
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + piece)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def feature_buckets(text: bytes, most: int = MOST, buckets: int = BUCKETS, piece: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """Part by part of a UTF-8 text: the number of words, and the bucket of every run of 1 to ``most`` words."""
    tail: list[bytes] = []
    for words in _words(text, piece):
        held = tail + words
        sums = [zlib.crc32(w) for w in held]
        parts = [sums[len(tail):]]
        for length in range(2, most + 1):  # a run's checksum goes on from the one without its last word
            sums = [zlib.crc32(b" " + w, s) for s, w in zip(sums, held[length - 1:])]
            parts.append(sums[max(0, len(tail) - length + 1):])
        yield len(words), np.fromiter((s for p in parts for s in p), np.int64, sum(map(len, parts))) % buckets
        tail = held[len(held) - (most - 1):] if most > 1 else []


def bucket_counts(docs: DataFrame, text: str = "text", most: int = MOST, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows; each task sends one row per bucket it met, the driver gets ``buckets`` rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                for _, places in feature_buckets(raw or b"", most, buckets):
                    found += np.bincount(places, minlength=buckets)
        met = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(found[met], pa.int64())], names=["bucket", "n"])

    rows = docs.select(F.col(text).cast("binary").alias("raw")).mapInArrow(count, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log odds of every bucket in thousandths, rounded down; each bucket counts one feature more than it has."""
    size = len(corpus)
    more, less = float(target.sum()) + size, float(corpus.sum()) + size
    return np.array([math.floor(1000 * math.log((t + 1.0) * less / ((s + 1.0) * more)))
                     for s, t in zip(corpus.astype(float), target.astype(float))], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text", doc_id: str = "doc_id", most: int = MOST) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every row: the sum of its features' gains."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, raw in enumerate(batch.column(1)):
                for n, places in feature_buckets(raw.as_py() or b"", most, buckets):
                    out[:, i] += n, len(places), gain[places].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out)],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("raw")).mapInArrow(
        weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A standard Gumbel number of the id in thousandths, rounded down; the null id counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(text, 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("bigint")


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS, seed: int = SEED):
    """The ``k``-th smallest (from 1) of the distinct values of the one column ``key``; None if there are fewer.

    Each round draws pivots at random among the keys still in question, counts all of those below,
    between and at the pivots exactly, and keeps the one interval that holds the k-th. Rounds grow
    with the logarithm of the number of keys; the rows of a round are written once, and each is
    expected to be smaller by the number of pivots.
    """
    if k < 1:
        return None
    for turn in range(200):
        drawn = keys.orderBy(F.xxhash64("key", F.lit(seed + turn)), "key").limit(pivots).collect()
        fixed = sorted(drawn, key=lambda r: tuple(r.key))
        if not fixed:
            return None
        probes = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r.key, keys.schema["key"].dataType)])
                           for r in fixed])
        below, at = F.size(F.filter(probes, lambda p: p < F.col("key"))), F.array_contains(probes, F.col("key"))
        counted = {(r.slot, r.hit): r.n for r in keys.groupBy(below.alias("slot"), at.alias("hit")).agg(F.count("*").alias("n")).collect()}
        for slot in range(len(fixed) + 1):
            between = counted.get((slot, False), 0)
            if k <= between:
                break
            k -= between
            if slot == len(fixed):
                return None
            if k <= counted.get((slot, True), 0):
                return fixed[slot].key
            k -= counted.get((slot, True), 0)
        keys = written(keys.where((below == slot) & ~at))
    raise RuntimeError("the selection did not settle")


def draw(scored: DataFrame, k_of, doc_id: str = "doc_id", eligible: Column | None = None) -> DataFrame:
    """Add ``rank`` (from 1; null where not drawn) to the rows with the highest ``score``, ties to the smaller id.

    ``k_of`` gives the number to draw from the number of eligible rows. Among equal scores a null id comes
    last; repeated rows are drawn one by one. ``scored`` is written once; only winners are sorted.
    """
    on = F.coalesce(eligible, F.lit(False)) if eligible is not None else F.lit(True)
    held = written(scored.withColumns({"_on": on, "_row": F.monotonically_increasing_id()}))
    n = held.where("_on").count()
    # with the place in the table no two keys are equal, so exactly k rows lie at or before the k-th;
    # a null has no place in a comparison of keys, so a flag stands for it
    key = F.struct((-F.col("score")).alias("score"), F.col(doc_id).isNull().alias("none"),
                   F.coalesce(doc_id, F.lit(0)).cast("bigint").alias("id"), F.col("_row").alias("row"))
    last = kth_key(held.where("_on").select(key.alias("key")), k_of(n))
    columns = scored.columns
    if last is None:
        return held.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    edge = F.struct(*[F.lit(v).alias(name) for name, v in last.asDict().items()])
    won = F.col("_on") & (key <= edge)
    winners = held.where(won).select(*columns, key.alias("_key")).select(
        *columns, *[F.col(f"_key.{x}").alias(f"_key_{x}") for x in ("score", "none", "id", "row")])
    ranked = global_row_number(winners, [f"_key_{x}" for x in ("score", "none", "id", "row")], 1, "rank")
    return ranked.select(*columns, "rank").unionAll(held.where(~won).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, text: str = "text",
             doc_id: str = "doc_id", target_text: str = "text", most: int = MOST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every row of ``docs``.

    Each row is a document of its own, also where ids or texts repeat. Null and empty texts have no words and
    weight 0; a null id scores as the empty text would and comes after equal scores. Of the documents with at least
    ``least_words`` words, ``percent`` of a hundred (rounded down) are drawn. Without target texts gains only mirror the corpus;
    an empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, text, most, buckets), bucket_counts(target, target_text, most, buckets))
    scored = weighed(docs, gain, text, doc_id, most).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return draw(scored, lambda n: percent * n // 100, eligible=F.col("n_words") >= least_words)


@query("op13_importance_resampling")
def op13(spark, sf_dir):
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
