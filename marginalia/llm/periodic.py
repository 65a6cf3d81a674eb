"""Periodic runs of words by internal pattern matching, and texts collapsed to one period of each run.

Words of a document become numbers; blocks of 4, 8, 16 ... words, half overlapping, ask for their next
occurrence in the neighbouring window: a range successor over the suffix array, answered by a wavelet
matrix. Occurrences of a block within its own length lie in progression, so the distance to the next
one is the smallest period there; comparing blocks of the same numbers extends it to the whole run.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import query, small_batches, table

#: A run is at least so many words and at least so many periods long. Blocks of 2^k words at every 2^(k-1)th word
#: meet every run of these or more: 4q - 4 words hold a whole block, the half before it and one period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of several documents that are searched together; a longer document is searched alone.
TOGETHER = 1 << 16
BLANKS = r"[\x20\x09-\x0D]+"
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def block_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """For every k and place, where the block of 2^k words from there stands first among all sorted ones.

    Equal blocks share a number; the last of the arrays has no equal numbers: it is the inverse suffix array.
    Only blocks that are still equal to others are sorted again.
    """
    n = len(ids)
    place = np.arange(n)

    def starts(keys: np.ndarray) -> np.ndarray:  # of sorted keys, where each one's equals begin
        return np.maximum.accumulate(np.where(np.r_[True, keys[1:] != keys[:-1]], np.arange(len(keys)), 0))

    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int32)
    rank[order] = starts(ids[order])
    levels, step = [rank], 1
    while True:
        shared = place[np.bincount(rank, minlength=n)[rank] > 1]
        if not len(shared):
            return levels
        ahead = np.zeros(len(shared), np.int64)
        inside = shared + step < n
        ahead[inside] = rank[shared[inside] + step] + 1
        keys = rank[shared].astype(np.int64) * (n + 1) + ahead
        order = np.argsort(keys, kind="stable")
        shared, keys = shared[order], keys[order]
        finer = rank.copy()
        finer[shared] += (starts(keys) - starts(keys // (n + 1))).astype(np.int32)
        levels.append(finer)
        rank, step = finer, 2 * step


class WaveletMatrix:
    """Bit by bit ranks of a sequence of numbers; answers many queries at a time."""

    def __init__(self, values: np.ndarray):
        self.size, self.levels = len(values), []
        for bit in reversed(range(max(1, int(values.max(initial=0)).bit_length()))):
            ones = (values >> bit & 1).astype(bool)
            zeros = np.r_[0, np.cumsum(~ones)].astype(np.int32)  # zero bits before each place
            self.levels.append((bit, zeros))
            values = np.concatenate([values[~ones], values[ones]])

    def successor(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each query the smallest number that is ``least`` or more at the places ``lo`` to ``hi``; -1 for none."""
        a, b, below = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        for bit, zeros in self.levels:  # how many are smaller
            one = (least >> bit & 1).astype(bool)
            za, zb = zeros[a], zeros[b]
            below += np.where(one, zb - za, 0)
            a, b = np.where(one, zeros[-1] + a - za, za), np.where(one, zeros[-1] + b - zb, zb)
        below = np.where(least >> len(self.levels) > 0, hi - lo, below)
        found = below < hi - lo
        a, b, left, value = lo[found], hi[found], below[found], np.zeros(int(found.sum()), np.int64)
        for bit, zeros in self.levels:  # the one after them
            za, zb = zeros[a], zeros[b]
            one = left >= zb - za
            left = np.where(one, left - (zb - za), left)
            value |= one.astype(np.int64) << bit
            a, b = np.where(one, zeros[-1] + a - za, za), np.where(one, zeros[-1] + b - zb, zb)
        out = np.full(len(lo), -1)
        out[found] = value
        return out


def _candidates(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances: a block from there occurs next so many words further, within its own length."""
    n = len(levels[0])
    if len(levels) < 4:  # no block of four words occurs twice
        return np.empty(0, np.int64), np.empty(0, np.int64)
    suffixes = np.empty(n, np.int64)
    suffixes[levels[-1]] = np.arange(n)
    # blocks that occur once have no next occurrence: the matrix holds the places of the others
    twice = np.bincount(levels[2], minlength=n)[levels[2]] > 1
    held = twice[suffixes]
    before, places = np.r_[0, np.cumsum(held)], np.flatnonzero(twice)
    number = np.cumsum(twice) - 1
    matrix = WaveletMatrix(number[suffixes[held]])
    asked = []
    for k, rank in enumerate(levels[:-1]):
        if k < 2:
            continue
        s = np.arange(0, n, 1 << (k - 1))
        size = np.bincount(rank, minlength=n)
        s = s[size[rank[s]] > 1]
        asked.append((s, before[rank[s]], before[rank[s] + size[rank[s]]], np.full(len(s), k)))
    s, lo, hi, k = (np.concatenate(x) for x in zip(*asked))
    following = matrix.successor(lo, hi, number[s] + 1)
    s, k, following = s[following >= 0], k[following >= 0], following[following >= 0]
    distance = places[following] - s
    near = (distance <= 1 << k) & ((k == 2) | (distance > 1 << (k - 1)))  # shorter ones show in shorter blocks
    return s[near], distance[near]


def runs_of(ids: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period. ``ids``: the words as numbers."""
    if len(ids) < LEAST_WORDS:
        return np.empty((0, 3), np.int64)
    levels = block_ranks(ids)
    s, period = _candidates(levels)
    n, right, left = len(ids), s.copy(), s.copy()
    for k in reversed(range(len(levels) - 1)):  # as far as words a period apart are equal
        step, rank = 1 << k, levels[k]
        on = right + period < n
        on[on] = rank[right[on]] == rank[(right + period)[on]]
        right[on] += step
        on = left >= step
        on[on] = rank[left[on] - step] == rank[(left + period)[on] - step]
        left[on] -= step
    length = right + period - left
    found = np.stack([left, length, period], axis=1)[(length >= LEAST_WORDS) & (length >= LEAST_PERIODS * period)]
    found = np.unique(found, axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _searched(texts: list[bytes], together: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """``(words, runs)`` of every text in order; numbers differ between documents, so nothing matches across them."""
    held, ids, total = [], [], 0

    def search():
        edges = np.cumsum([0] + [len(w) for w in held])
        runs = runs_of(np.concatenate([np.array(x, np.int64) for x in ids])) if total else np.empty((0, 3), np.int64)
        cut = np.searchsorted(runs[:, 0], edges)
        for words, edge, (a, b) in zip(held, edges, pairwise(cut)):
            yield words, runs[a:b] - (edge, 0, 0)

    known = 0
    for text in texts:
        words = text.split()  # of bytes: at blank, tab, line feed, vertical tab, form feed, carriage return
        if total + len(words) > together and held:
            yield from search()
            held, ids, total, known = [], [], 0, 0
        numbers: dict[bytes, int] = {}
        ids.append([numbers.setdefault(w, known + len(numbers)) for w in words])
        held.append(words)
        total, known = total + len(words), known + len(numbers)
    yield from search()


def _kept(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but for those that a run holds after its first period, joined by blanks."""
    if len(runs):
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
    return b" ".join(words)


def _number_lists(runs: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
    rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r) for r in runs]), pa.int32()), rows)


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", together: int = TOGETHER) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of every row: all runs by start and period, and the text without repeats.

    A run is a stretch of words that equal the ones ``period`` words before, with no smaller period, at least
    six words and four periods long, that no neighbouring word extends. ``collapsed`` has the words outside
    runs and of each run's first period, joined by one blank. Rows with equal ids or texts are judged one by
    one; null and empty texts have no words, no runs and an empty text; null ids stay; an empty table gives an
    empty one; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, texts = [], [], []
            for words, found in _searched([x or b"" for x in batch.column(1).to_pylist()], together):
                sizes.append(len(words))
                runs.append(found)
                texts.append(_kept(words, found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), _number_lists(runs), pa.array(texts, pa.binary())],
                                             names=["doc_id", "n_words", "runs", "collapsed"])

    out = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("raw")).mapInArrow(
        search, f"doc_id bigint, n_words bigint, runs {RUN}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(text: Column, doc_id: Column) -> Column:
    """The text, of one document in ten with its words from a on repeating with period p; ids decide which, a and p."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(
            words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")).otherwise("")

    split = F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")
    # a list of one binds the words, so that they are split once
    return F.when(h % 10 == 0, F.get(F.transform(F.array(split), repeat), F.lit(0))).otherwise(text)


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                    r["period"].cast("string"), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
                        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
