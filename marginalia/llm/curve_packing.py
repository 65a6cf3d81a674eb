"""Packing along a space-filling curve: like documents next to each other, sequences without gaps.

A document's token ids are hashed into a signed count vector, projected to a few dimensions and
placed on a Hilbert curve. Documents are range-sorted by that key; each one's place in the stream
of all tokens is the sum of the lengths before it, and sequences are the stream's cuts every 1024
tokens. Only the last sequence of all is not full.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.bpe import MEMO, Memo, of_worker, text_encoder
from marginalia.llm.common import query, small_batches, table, written

SEQUENCE = 1024
END = 0
#: Hashed vector size, curve dimensions, bits per dimension; dimensions * bits is at most 62.
BUCKETS, DIMENSIONS, DEPTH = 256, 4, 12
#: Ranges per shuffle partition, so that ranges spread evenly over tasks.
RANGES = 4


class LibraryWords:
    """Ids of single pre-tokens by the tokenizers library's model, remembered."""

    def __init__(self, vocabulary: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary).model
        self.memo, self.known = memo, Memo(memo)
        # byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.written = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}

    def encode(self, match: str) -> tuple[int, ...]:
        got = self.known.get(match)
        if got is None:
            got = self.fresh(match)
            if len(match) <= 64:
                self.known.keep(match, got)
        return got

    def fresh(self, match: str) -> tuple[int, ...]:
        spelled = match.encode("utf-8").decode("latin-1").translate(self.written)
        return tuple([token.id for token in self.model.tokenize(spelled)])


def hilbert_key(points, depth: int):
    """Places on the Hilbert curve of integer points (rows) below ``2 ** depth``, as 64-bit numbers.

    Bit by bit from the top, axes are reflected and exchanged as the curve turns; the Gray code of
    the turned bits, read across the axes, is the place.
    """
    import numpy as np

    x = np.array(points, dtype=np.int64).T.copy()
    axes = len(x)
    for bit in range(depth - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(axes):
            on = (x[i] >> bit) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(depth - 1, 0, -1):
        turn ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(depth - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_places(batch: list):
    """Hilbert keys of documents given as arrays of ids."""
    import numpy as np

    rnd = np.random.default_rng(20)
    project = rnd.standard_normal((BUCKETS, DIMENSIONS))
    rows = np.zeros((len(batch), BUCKETS))
    for i, ids in enumerate(batch):
        hashed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # wraps around
        sign = np.where((hashed >> np.uint64(20)) & np.uint64(1), 1.0, -1.0)
        rows[i] = np.bincount((hashed >> np.uint64(56)).astype(np.int64) % BUCKETS, sign, BUCKETS)
    rows = np.sign(rows) * np.log1p(np.abs(rows))
    low = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12) @ project
    cells = np.clip(((low / 3 + 1) / 2 * (1 << DEPTH)).astype(np.int64), 0, (1 << DEPTH) - 1)
    return hilbert_key(cells, DEPTH)


def id_bytes(vocabulary: str) -> int:
    """Bytes that an id of the vocabulary needs: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 else 4


def tokens_on_curve(vocabulary: str, pattern: str, width: int = 4, end: int = END):
    """Column function ``text -> (ids, place)``: ids of ``width`` bytes each, ``end`` last, and the place on the curve."""
    @F.pandas_udf("ids binary, place long")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np

        encode = of_worker(("words", vocabulary, pattern), lambda: text_encoder(LibraryWords(vocabulary), pattern))
        for texts in batches:
            ids = [np.append(np.frombuffer(encode(t or ""), dtype="<u4"), np.uint32(end)).astype(f"<u{width}") for t in texts]
            yield pd.DataFrame({"ids": pd.Series([x.tobytes() for x in ids], dtype=object), "place": pd.Series(curve_places(ids), dtype="int64")})

    return coded


def stream_starts(narrow: DataFrame, ranges: int) -> DataFrame:
    """``(row, start)``: the sum of ``n`` over all rows before each in the order ``(place, doc_id, row)``.

    Rows are dealt into ranges of the order; sums run inside each range, and the sums of whole ranges
    (a row per range) are added up on their own.
    """
    dealt = written(narrow.repartitionByRange(ranges, "place", "doc_id", "row").withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("range").agg(F.sum("n").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy("place", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return summed.join(F.broadcast(totals), "range").select("row", (F.col("base") + F.col("inside")).alias("start"))  # a row per range


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(size: int, width: int):
    def cut(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        names = [f.split()[0] for f in PIECES.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, begin, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "begin", "ids"))):
                n, at = len(ids) // width, 0
                ids = memoryview(np.frombuffer(ids, dtype=f"<u{width}").astype("<u4").tobytes())
                while at < n:
                    sequence, offset = divmod(begin + at, size)
                    length = min(size - offset, n - at)
                    for column, value in zip(out, (doc, at, length, zlib.crc32(ids[4 * at:4 * (at + length)]), n, sequence, offset)):
                        column.append(value)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in out], names=names)

    return cut


def pack(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", doc_id: str = "doc_id", size: int = SEQUENCE) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of all rows.

    Each row of ``docs`` is a document of its own, also where ids or texts repeat; null and empty
    texts hold the end token only; an empty table gives no pieces; other columns are ignored.
    Documents are tokenised once; ids wait in the shared folder while the places are summed up over
    narrow rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    width = id_bytes(vocabulary)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), tokens_on_curve(vocabulary, pattern, width)(F.col(text)).alias("x"))
    coded = written(rows.select("doc_id", "x.ids", "x.place", F.monotonically_increasing_id().alias("row")))
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = coded.select("row", "doc_id", "place", (F.length("ids") / width).cast("long").alias("n"))
    starts = stream_starts(narrow, ranges)
    joined = coded.select("row", "doc_id", "ids").join(starts, "row").select("doc_id", F.col("start").alias("begin"), "ids")
    return joined.mapInArrow(_cut(size, width), PIECES)


@query("op5_curve_packing")
def op5(spark, sf_dir):
    import public_tokenizers as public

    return pack(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.PATTERN)
