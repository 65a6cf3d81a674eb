"""Mixing sources to target weights: water-filled targets, whole copies by pivotal dependent rounding.

Every document of a source is due the same number of copies, a fraction mostly. Two fractions at a
time trade words, the one going up by what the other goes down, with odds that keep each one's
expectation, until one of them is whole; groups of documents do so side by side, and the one
fraction that each leaves goes on to the next level of a tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import query, table, written
from marginalia.operators.keyed import global_row_number

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix per word of all documents, and the most copies of a document.
SHARE, MOST_COPIES = 1.0, 3
SEED = 11
#: A group of the tree holds 2^6 fractions.
GROUP_BITS = 6
#: Rows of one source are spread over so many tasks where they meet its target.
SALTS = 32


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """``(source, ordinal, source_size, target)``: words by weight, none above ``most`` times its source's words.

    What a source cannot take is shared by the others by weight, again until none is above. Each
    turn is one aggregate over the sources; at most as many turns as sources run, mostly two or three.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    ordered = written(global_row_number(per, ["none", "source"], 0, "ordinal").withColumn(
        "weight", F.get(F.array(*[F.lit(w).cast("double") for w in weights]), (F.col("ordinal") % len(weights)).cast("int"))).drop("none"))
    cap = (F.col("source_size") * most).cast("double")
    all_words = ordered.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * level > cap if capped >= 0 else F.lit(False)
        r = ordered.agg(F.count_if(above).alias("n"), F.sum(F.when(above, cap)).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if r.n == capped or not r.open:
            break
        level, capped = (all_words * share - (r.full or 0.0)) / r.open, r.n
    return ordered.select("source", "ordinal", "source_size", F.least(cap, F.col("weight") * level).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number from 0 to 1 that the whole numbers given determine."""
    return F.shiftrightunsigned(F.xxhash64(*[p.cast("bigint") for p in parts]), 11) * F.lit(2.0 ** -53)


def _trade(held: Column, item: Column) -> Column:
    """One pivotal step of the fold: ``held(i, p, size, done)`` has the fraction left so far, ``item(i, p, size, u)`` comes.

    Words move from one to the other until either is whole; that one goes to ``done``, the other stays.
    """
    p, q, ratio = held["p"], item["p"], item["size"] / held["size"]
    up, down = F.least(1 - p, q * ratio), F.least(p, (1 - q) * ratio)
    rises = item["u"] * (up + down) < down  # expectations stay: up * P(rises) = down * P(falls)
    whole = F.when(rises, 1 - p <= q * ratio).otherwise(p <= (1 - q) * ratio)  # the held one, else the item
    left = F.when(whole, q + F.when(rises, p - 1).otherwise(p) / ratio).otherwise(p + F.when(rises, q).otherwise(q - 1) * ratio)
    step = F.struct(F.when(whole, item["i"]).otherwise(held["i"]).alias("i"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), left)).alias("p"),
                    F.when(whole, item["size"]).otherwise(held["size"]).alias("size"),
                    F.concat(held["done"], F.array(F.struct(F.when(whole, held["i"]).otherwise(item["i"]).alias("i"), (whole == rises).alias("up")))).alias("done"))
    first = F.struct(item["i"].alias("i"), item["p"].alias("p"), item["size"].alias("size"), held["done"].alias("done"))
    return F.when(held["i"] < 0, first).otherwise(step)


def dependent_rounding(rows: DataFrame, count: int, seed: int = SEED, bits: int = GROUP_BITS) -> DataFrame:
    """``(row, up)``: each fraction rounded up or down, the words of a key kept but for its last fraction.

    ``rows(key bigint, place bigint, p double, size bigint, row struct)`` with places from 0 to
    ``count`` - 1, those of a key in sequence, and positive sizes. A level of the tree groups 2^bits
    places of a key, so a group is bounded whatever the key; it leaves one fraction, in expectation
    what it was. The last one of a key is rounded at random by its fraction.
    """
    parts, level = [], 0
    while True:
        group = F.shiftright("place", bits * (level + 1)).alias("group")
        items = F.array_sort(F.collect_list(F.struct("place", "p", "size", "row")))
        packed = rows.groupBy("key", group).agg(items.alias("items"))
        coins = F.transform("items", lambda x, i: F.struct(i.alias("i"), x["p"].alias("p"), x["size"].alias("size"), _uniform(
            F.lit(seed), F.lit(level), x["place"]).alias("u")))
        start = F.struct(F.lit(-1).alias("i"), F.lit(0.0).alias("p"), F.lit(1).cast("bigint").alias("size"),
                         F.array().cast("array<struct<i:int,up:boolean>>").alias("done"))
        folded = written(packed.select("key", "items", F.aggregate(coins, start, _trade).alias("x")).select(
            "key", F.transform("x.done", lambda d: F.struct(F.get("items", d["i"])["row"].alias("row"), d["up"].alias("up"))).alias("done"),
            F.get("items", F.col("x.i")).alias("rest"), F.col("x.p").alias("p")))
        parts.append(folded.select(F.explode("done").alias("d")).select("d.row", "d.up"))
        rows = folded.select("key", "rest.place", "p", "rest.size", "rest.row")
        level += 1
        if count <= 1 << bits * level:
            break
    parts.append(rows.select("row", (_uniform(F.lit(seed), F.lit(-1), F.col("place")) < F.col("p")).alias("up")))
    return reduce(DataFrame.unionAll, parts)


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
        share: float = SHARE, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` of every row.

    ``size`` is the number of words (null and empty texts: 0), ``copies`` 0 to ``most`` whole ones, ``taken`` the words of
    all copies. A source's taken words differ from its target by less than one document, mostly a small one: larger
    documents are rounded first. Null sources are one source, the last; rows with equal or null ids are documents of
    their own, and equal rows share their copies in any order; other columns are ignored; an empty table gives an
    empty one. The same rows give the same mix whatever their partitions.
    """
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint")
    sized = written(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"),
                                F.monotonically_increasing_id().alias("nth")))
    goals = source_targets(sized, weights, share, most).select(
        F.col("source").alias("goal"), "ordinal", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = sized.withColumn("salt", F.pmod(F.xxhash64("nth"), F.lit(SALTS)).cast("int"))
    due = near.join(goals, (near["salt"] == goals["salt"]) & F.col("source").eqNullSafe(F.col("goal"))).select(
        "doc_id", "source", "size", "nth", "ordinal", "source_size", "target", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("p"))
    due = written(due)
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    # large ones first; nth only parts rows that are equal in all that is returned
    lined = global_row_number(due.where(open_).withColumns({"less": -F.col("size"), "mark": F.xxhash64("doc_id", F.lit(seed).cast("bigint")),
                                                            "none": F.col("doc_id").isNull()}),
                              ["ordinal", "less", "mark", "none", "doc_id", "nth"], 0, "place")
    kept = ["doc_id", "source", "size", "source_size", "target", "whole"]
    rounded = dependent_rounding(lined.select(F.col("ordinal").alias("key"), "place", "p", "size", F.struct(*kept).alias("row")),
                                 due.where(open_).count(), seed)
    out = rounded.select("row.*", F.col("up").cast("bigint").alias("up")).unionAll(
        due.where(~open_).select(*kept, F.lit(0).cast("bigint").alias("up")))
    copies = F.col("whole") + F.col("up")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


@query("op11_pivotal_mixing")
def op11(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
