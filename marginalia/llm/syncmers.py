"""Document fingerprints from closed syncmers.

Of all substrings of ``K`` code points, those are anchors whose smallest inner substring of ``S`` (by
hash) lies at the front or the back. Whether a substring is an anchor depends on nothing around it,
so a passage has the same anchors wherever it stands: the anchors of an edited text are those of the
kept part, told by their positions, and those that reach into the new part.

The fingerprint is a sketch of the anchor set: anchors fall into ``CELLS`` cells by hash, and each
cell keeps its smallest. The likeness of two fingerprints is the share of cells, filled in either, in
which they agree: an estimate of the anchors' overlap. Everything is built-in expressions; texts are
read as UTF-32, where a substring is found without counting from the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import query, table

K, S, CELLS = 12, 8, 64
#: Order blocks per shuffle partition.
BLOCKS = 8
EMPTY = "----"


def _gram(bin_: Column, i: Column, n: int) -> Column:
    return F.substr(bin_, (4 * i + 1).cast("int"), F.lit(4 * n))


def is_anchor(bin_: Column, i: Column) -> Column:
    """Whether the ``K`` code points from ``i`` (0-based) of UTF-32 bytes are a closed syncmer."""
    h = [F.xxhash64(_gram(bin_, i + j, S)) for j in range(K - S + 1)]
    return F.least(h[0], h[-1]) <= F.least(*h[1:-1])


def _places(bin_: Column) -> Column:
    """-1, which stands for the whole text, and all starts of ``K`` code points."""
    return F.sequence(F.lit(-1), F.greatest(F.floor(F.length(bin_) / 4).cast("int") - K, F.lit(-1)))


def anchors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, position, hash)`` of every anchor of every text; null texts are empty, and have none."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-32").alias("bin"))
    i = F.col("position")
    return (rows.select("doc_id", "bin", F.explode(_places(F.col("bin"))).alias("position"))
            .where((i >= 0) & is_anchor(F.col("bin"), i)).select("doc_id", "position", F.xxhash64(_gram(F.col("bin"), i, K)).alias("hash")))


def _upto(bounds: list[int], x: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``x``, by bisection."""
    if not bounds:
        return F.lit(0)
    steps = [1 << p for p in range(len(bounds).bit_length() - 1, -1, -1)]
    held = F.array(*[F.lit(b).cast("long") for b in bounds]) if len(bounds) < 64 else F.from_json(F.lit(str(bounds)), "array<bigint>")
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
        (at + step <= len(bounds)) & (F.try_element_at(held, at + step) <= x), at + step).otherwise(at))


def with_next(docs: DataFrame, text: str, doc_id: str, blocks: int) -> DataFrame:
    """``(block, key, wrap, doc_id, text, next_text)``: each row and the text after it by ascending id.

    Ids are cut into blocks of like size at quantiles (a number per block goes through the driver, as
    many as there are blocks); the first row of each block is also sent, as a copy with ``wrap`` set,
    to the block before it, and the first of all behind the last. Texts move once. Rows without an id
    come first; rows that repeat an id are in order of their texts.
    """
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("key"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("key", [i / blocks for i in range(1, blocks)] or [0.5], 20 * blocks).alias("q")).first().q or []
    bounds = sorted(set(cuts))
    placed = rows.withColumn("block", _upto(bounds, F.col("key")))
    firsts = sorted((r.block, r.low) for r in placed.groupBy("block").agg(F.min("key").alias("low")).collect())
    before = [(firsts[n - 1][0], low) for n, (_, low) in enumerate(firsts)]  # the first's block before is the last
    # whose copy goes where: the n-th block's smallest key to the block before it
    lows = [low for _, low in firsts]
    at = _upto(lows, F.col("key"))
    is_first = F.try_element_at(_longs(lows), at) == F.col("key")
    copy = F.when(is_first, F.struct(F.try_element_at(_longs([b for b, _ in before]), at).cast("int").alias("block"),
                                     F.when(at == 1, 2).otherwise(1).alias("wrap")))
    sent = F.filter(F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("wrap")), copy), lambda x: x.isNotNull())
    dealt = placed.select("key", "doc_id", "text", F.explode(sent).alias("to")).select("key", "doc_id", "text", "to.block", "to.wrap")
    order = Window.partitionBy("block").orderBy(F.col("wrap") == 2, "key", "text", "wrap")
    return dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("place", F.row_number().over(order))


def _longs(values: list[int]) -> Column:
    """An array literal of any length."""
    return F.from_json(F.lit(str([int(v) for v in values])), "array<bigint>")


def likeness(a: Column, b: Column) -> Column:
    """Share of cells, filled in either sketch, in which both agree; 0 to 1."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == EMPTY) & (y == EMPTY), None).otherwise(x == y))
    filled = F.filter(both, lambda x: x.isNotNull())
    return F.size(F.filter(filled, lambda x: x)) / F.greatest(F.size(filled), F.lit(1))


def _sketch(cells: Column, side: str) -> Column:
    """``CELLS`` short strings from ``array(struct(cell, own, edited))``; a text without anchors is told by its own hash."""
    last4 = lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND(F.lit(0xFFFF)))), 4, "0")
    held = F.map_from_entries(F.transform(F.filter(cells, lambda c: c[side].isNotNull()), lambda c: F.struct(c["cell"], c[side])))
    whole = F.try_element_at(held, F.lit(-1).cast("long"))
    cell = F.sequence(F.lit(0).cast("long"), F.lit(CELLS - 1).cast("long"))
    some = F.transform(cell, lambda c: F.coalesce(last4(F.try_element_at(held, c)), F.lit(EMPTY)))
    none = F.transform(cell, lambda c: last4(F.xxhash64(whole, c)))
    return F.when(F.size(held) > 1, some).otherwise(none)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` per row.

    Null texts count as empty; a text without anchors (shorter than ``K``, or a single one that is
    none) is fingerprinted by its whole hash; a lone row is its own next one; an empty table gives no
    rows; other columns are ignored.
    """
    blocks = BLOCKS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, text, doc_id, blocks)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    texts = (rows.withColumn("n_chars", n.cast("long")).withColumn("kept", n - half).withColumn("edited", edited)
             .select("block", "place", "wrap", "doc_id", "n_chars", "kept", F.sha2("edited", 256).alias("edited_sha256"),
                     F.array(F.struct(F.lit(True).alias("own"), F.xxhash64("text").alias("whole"), F.encode("text", "UTF-32").alias("bin")),
                             # the new part with as much before it as an anchor can reach back
                             F.struct(F.lit(False).alias("own"), F.xxhash64("edited").alias("whole"),
                                      F.encode(F.substr("edited", F.greatest(F.col("kept") - (K - 1), F.lit(0)) + 1), "UTF-32").alias("bin"))).alias("parts")))
    keys = ["block", "place", "wrap", "doc_id", "n_chars", "edited_sha256"]
    part = texts.select(*keys, "kept", F.explode("parts").alias("x")).select(*keys, "kept", "x.own", "x.whole", "x.bin")
    i, bin_ = F.col("i"), F.col("bin")
    hits = (part.select(*keys, "kept", "own", "whole", "bin", F.explode(_places(bin_)).alias("i"))
            .where((i < 0) | is_anchor(bin_, i)))
    h = F.xxhash64(_gram(bin_, i, K))
    # the low bits choose the cell, the others are compared
    cell = F.when(i < 0, F.lit(-1).cast("long")).otherwise(h.bitwiseAND(F.lit(CELLS - 1)))
    value = F.when(i < 0, F.col("whole")).otherwise(F.shiftrightunsigned(h, 6))
    told = hits.select(*keys, cell.alias("cell"), value.alias("v"), F.col("own").alias("of_own"),
                       (~F.col("own") | (i >= 0) & (i + K <= F.col("kept"))).alias("of_edited"))
    mins = told.groupBy(*keys, "cell").agg(F.min(F.when(F.col("of_own"), F.col("v"))).alias("own"),
                                           F.min(F.when(F.col("of_edited"), F.col("v"))).alias("edited"))
    cells = mins.groupBy(*keys).agg(F.collect_list(F.struct("cell", "own", "edited")).alias("cells"))  # at most CELLS + 1
    made = cells.select(*keys, _sketch(F.col("cells"), "own").alias("own"), _sketch(F.col("cells"), "edited").alias("edited"))
    after = Window.partitionBy("block").orderBy("place")
    both = made.withColumn("next", F.lead("own").over(after)).where("wrap = 0")
    return both.select("doc_id", "n_chars", "edited_sha256", F.array_join("own", "").alias("fingerprint"),
                       F.array_join("edited", "").alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"),
                       F.when(F.col("next").isNotNull(), likeness(F.col("own"), F.col("next"))).otherwise(F.lit(0.0)).alias("near_next"))


@query("op8_syncmers")
def op8(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
