"""SimHash near-dedup: fingerprints of word shingles, linked by covering locality-sensitive hashing.

Bit masks: every bit position gets a non-zero vector of F2^(radius+1); mask ``v`` holds the positions
whose vector has inner product 1 with ``v``. Two fingerprints that differ in at most ``radius``
positions leave some ``v`` orthogonal to all of those positions' vectors, so they agree on mask
``v`` and meet in its table: no pair within the radius is missed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from marginalia.llm.common import checkpointed, forget, id_bitmap, id_filter, query, small_batches, table, written
from marginalia.llm.components import components

BITS, RADIUS = 64, 2
SEED = 42
#: Buckets with more fingerprints than this meet through neighbour points instead of pairs; both are exact.
PAIR_BUCKET = 24


def words_of(text) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _hashes(words: list[bytes], k: int, hashed) -> Iterator:
    """Hashes of all runs of ``k`` of the words, in slices of bounded memory."""
    import numpy as np

    n = len(words) - k + 1
    for start in range(0, n, 8192):
        part = words[start:min(start + 8192, n) + k - 1]
        yield np.array([hashed(b" ".join(s)) for s in zip(*(part[i:] for i in range(k)))], dtype="<u8")


def fingerprint_of(words: list[bytes], words_per_shingle: int, seed: int) -> int:
    """The signed fingerprint of :func:`simhash`."""
    import numpy as np
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    counts = np.zeros(64, dtype=np.int64)
    for hashes in _hashes(words, k, lambda s: xxh64_intdigest(s, seed)):
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(words) - k + 1, bitorder="little")
    return int(bits.view("<i8")[0])


def simhash(words_per_shingle: int = 3, seed: int = SEED):
    """Column function ``text -> long``: bit b is set when over half of the shingle hashes have it.

    Words are runs without ASCII white space, A-Z lower-cased; shingles keep their repeats; fewer
    words than a shingle form one shingle; no word (null and empty text too) gives 0. Whole texts are
    hashed, in slices of bounded memory.
    """
    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(words_of(t), words_per_shingle, seed) for t in texts], dtype="int64")

    return fingerprint


def _vectors(radius: int, bits: int = BITS) -> list[int]:
    """A non-zero vector of F2^(radius+1) per bit position, spread evenly and not by neighbourhood."""
    most = (1 << (radius + 1)) - 1
    return [1 + (b * 5 + b // most) % most for b in range(bits)]


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The ``2^(radius+1) - 1`` masks, as signed 64-bit numbers."""
    out = []
    for v in range(1, 1 << (radius + 1)):
        m = sum(1 << b for b, x in enumerate(_vectors(radius, bits)) if bin(x & v).count("1") % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``f``, whose closure joins all pairs within ``radius``.

    Every fingerprint enters one bucket per mask. In a small bucket all pairs are compared. In a
    large one (thousands of near copies) a fingerprint names the points one flipped bit away, on the
    bits its mask leaves free; two fingerprints differ in at most two bits exactly when they share
    such a point, and all that share a point hang onto its smallest: rows grow with the bucket, not
    with its square, and nothing is dropped. ``radius`` up to 2.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    every = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("mask")) for i, m in enumerate(masks(radius))])
    placed = (prints.select("f").distinct().select("f", F.explode(every).alias("x"))
              .select("f", F.col("x.t").alias("t"), F.col("x.mask").alias("mask"))
              .withColumn("key", F.col("f").bitwiseAND(F.col("mask"))))
    sizes = placed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = checkpointed(placed.join(sizes, ["t", "key"]))
    small = met.where(F.col("n") <= PAIR_BUCKET).select("t", "key", "f")
    pairs = (small.select("t", "key", F.col("f").alias("a")).join(small.select("t", "key", F.col("f").alias("b")), ["t", "key"])
             .where((F.col("a") < F.col("b")) & (hamming("a", "b") <= radius)).select("a", "b"))
    big = met.where(F.col("n") > PAIR_BUCKET)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(BITS)]) \
        if radius else F.array(F.lit(0).cast("long"))
    points = (big.select("t", "f", "mask", F.explode(flips).alias("flip"))
              .where(F.col("flip").bitwiseAND(F.col("mask")) == 0)
              .select("t", "f", F.col("f").bitwiseXOR(F.col("flip")).alias("p")))
    if radius == 1:  # a point in common may hide two differing bits; a fingerprint itself must be the point
        own = big.select("t", F.col("f").alias("p"))
        points = points.join(own.distinct(), ["t", "p"])
        stars = points.where("f != p").select(F.col("f").alias("a"), F.col("p").alias("b"))
    else:
        least = points.groupBy("t", "p").agg(F.min("f").alias("b"), F.count("*").alias("n")).where("n > 1").select("t", "p", "b")
        stars = points.join(least, ["t", "p"]).where("f != b").select(F.col("f").alias("a"), "b")
    return pairs.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS,
                    words_per_shingle: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row per row of ``docs``.

    ``fingerprint`` is the signed long; the component is the smallest id reachable over links of at
    most ``radius`` bits. Equal fingerprints fold to one row before any join, so a third of the
    corpus in one group of copies costs one row there. Null and empty texts have fingerprint 0 and
    link like any other; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    prints = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), simhash(words_per_shingle)(F.col(text)).alias("f")))
    groups = checkpointed(prints.groupBy("f").agg(F.min("doc_id").alias("least")))
    linked = components(near_links(groups, radius))
    roots = groups.join(linked, groups.f == linked.node, "left").select("f", "least", F.coalesce("component", "f").alias("root"))
    low = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(low, "root").select("f", "component_id")
    return prints.join(named, "f").select("doc_id", F.col("f").alias("fingerprint"), "component_id")


#: Near copies: words per shingle, and the least share of common shingles.
SHINGLE, SIMILAR = 5, 0.8
#: 64-bit parts of a sketch.
PARTS = 4
#: Bands of least hashes: two documents that share 0.8 of their shingles agree on one of the 50 bands of six with a
#: probability of 1 - (1 - 0.8^6)^50, so that 3 pairs in 10 million are missed there and fewer above.
BANDS, DEEP = 50, 6
#: Bits of a sketch that may differ: a pair at 0.8 differs in 25.6 of 256, with a deviation of 4.8; 2 in a million differ in more.
NEAR_BITS = 48


def shingle_set(words: list[bytes]):
    """The distinct hashes of a text's five-word shingles, in order. Fewer words than a shingle are one shingle, and no words none."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    if not words:
        return np.array([], dtype=np.uint64)
    return np.unique(np.concatenate(list(_hashes(words, min(SHINGLE, len(words)), xxh3_64_intdigest))))


def _set_name(hashes) -> int:
    """A signed number for a set of shingles."""
    from xxhash import xxh3_64_intdigest

    x = xxh3_64_intdigest(hashes.tobytes()) if len(hashes) else 0
    return x - (1 << 64) if x >> 63 else x


def shingle_sketch():
    """Column function ``text -> struct``: set of shingles by name (node) and size (n), one bit of 256 least hashes
    (s0..s3), a key per band, the SimHash of the shingles (f).

    One function for all, so that a task needs a single Python worker."""
    import random

    rnd = random.Random(7)
    turns = [(rnd.getrandbits(64) | 1, rnd.getrandbits(64)) for _ in range(BANDS * DEEP)]
    names = ["node", "n", *[f"s{i}" for i in range(PARTS)], "bands", "f"]

    @F.pandas_udf("node long, n int, " + ", ".join(f"s{i} long" for i in range(PARTS)) + ", bands array<long>, f long")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np
        from xxhash import xxh3_64_intdigest

        by, plus = (np.array(x, dtype=np.uint64)[:, None] for x in zip(*turns))

        def one(text) -> list:
            words = words_of(text)
            found = shingle_set(words)
            if not len(found):
                return [0, 0, *[0] * PARTS, [], 0]
            least = np.full(len(turns), 2 ** 64 - 1, dtype=np.uint64)
            for start in range(0, len(found), 512):
                np.minimum(least, (by * found[start:start + 512] + plus).min(axis=1), out=least)
            bits = np.packbits(((least[:64 * PARTS] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.uint8))
            keys = [xxh3_64_intdigest(least[i:i + DEEP].tobytes(), i) for i in range(0, len(turns), DEEP)]
            return [_set_name(found), len(found), *bits.view(">i8").tolist(), np.array(keys, dtype=np.uint64).view(np.int64),
                    fingerprint_of(words, SHINGLE, SEED)]

        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=names)

    return sketch


def set_names():
    """Column function ``text -> long``: the name of the text's set of shingles."""
    @F.pandas_udf("long")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_set_name(shingle_set(words_of(t))) for t in texts], dtype="int64")

    return named


def shingle_sets(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str, paths: list[str]) -> DataFrame:
    """``(node, h)``: 32 bits of each shingle hash of the sets in ``wanted(node, least)``, read again from the documents ``least``.

    A filter of bounded size is shipped first, so that few texts without candidates enter the join. It is looked up in
    the worker that hashes the texts: a task with a worker for each would hold twice their memory.
    """
    place, marked = id_bitmap(wanted, "least")

    def sets(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            kept = batch.filter(pa.array(marked(batch.column("_place").to_numpy())))
            each = [shingle_set(words_of(t)) for t in kept.column("_text").to_pylist()]
            low = [(x & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for x in each]
            ends = pa.array(np.cumsum([0, *map(len, low)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.array([], dtype=np.int32), *low])))
            yield pa.RecordBatch.from_arrays([kept.column("_id"), pa.array([_set_name(x) for x in each], pa.int64()), lists], names=["_id", "node", "h"])

    read = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), place(doc_id).alias("_place"))
    some = read.mapInArrow(sets, read.select("_id").schema.add("node", "long").add("h", ArrayType(IntegerType())))
    asked = wanted.select(F.col("node").alias("_node"), "least")
    # an id may repeat with other texts, so the set's name is compared too
    read = some.join(asked, F.col("_id").eqNullSafe(F.col("least")) & (F.col("node") == F.col("_node")), "left_semi")
    return written(read.select("node", "h").dropDuplicates(["node"]), paths)


def covered_pairs(groups: DataFrame) -> DataFrame:
    """Candidates ``(a, b)``, ``a < b``, among the nodes of ``groups(node, f)``: those whose fingerprints the covering masks link.

    Nodes of one fingerprint hang onto their smallest, and the smallest ones of linked fingerprints meet.
    """
    first = groups.where("n > 0").groupBy("f").agg(F.min("node").alias("first"))
    same = groups.where("n > 0").select("f", "node").join(first, "f").select(F.col("first").alias("a"), F.col("node").alias("b")).where("a != b")
    linked = near_links(first).join(first.select(F.col("f").alias("a"), F.col("first").alias("x")), "a") \
        .join(first.select(F.col("f").alias("b"), F.col("first").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionAll(linked)


def _grouped(docs: DataFrame, text: str, doc_id: str, similar: float, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, node)`` of every row, a node for each set of shingles, and ``(node, least, root)``: nodes of a group share a root.
    ``paths`` gets the folders that both are read from.

    Candidates come from the covering masks over SimHashes of the shingles (:func:`near_links`), and, as 0.8 is farther
    than the masks reach, from agreeing on a band of least hashes (:data:`BANDS`) at few differing bits of a sketch; they
    link when the exact share of common shingles, of both sets' hashes, is at least ``similar`` (0.8 or
    more). In a bucket everyone is compared with its first and last member, and
    what these links leave apart is then compared across the parts, all but the largest part with
    everyone: large groups of copies cost a multiple of their size, and no link between parts is
    lost. Equal sets fold before any join.
    """
    if similar < SIMILAR:
        raise ValueError(f"bands and sketches are made for similarities from {SIMILAR}")
    small_batches(docs.sparkSession)
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), shingle_sketch()(F.col(text)).alias("x")).select("doc_id", "x.*"), paths)
    signs_ = ["n", *[f"s{i}" for i in range(PARTS)]]
    # texts of one set of shingles may repeat them differently: one of their fingerprints stands for the set
    groups = written(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("f").alias("f"), *[F.first(c).alias(c) for c in (*signs_, "bands")]), paths)
    placed = groups.select("node", F.explode("bands").alias("key")).repartition("key")  # one shuffle for the next two steps
    ends = placed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    met = written(placed.join(ends, "key"), paths)
    signs = groups.select("node", *signs_)

    def sided(df: DataFrame, side: str) -> DataFrame:
        return df.withColumnsRenamed({"node": side, **{c: f"{side}_{c}" for c in ("part", "h", *signs_)}})

    def sets_of(nodes: DataFrame) -> DataFrame:
        return shingle_sets(docs, written(groups.select("node", "least").join(nodes.distinct(), "node", "left_semi"), paths), text, doc_id, paths)

    maybe = (sum((hamming(f"a_s{n}", f"b_s{n}") for n in range(1, PARTS)), hamming("a_s0", "b_s0")) <= NEAR_BITS) \
        & (F.least("a_n", "b_n") >= F.lit(similar) * F.greatest("a_n", "b_n") - 1e-6)
    common = F.size(F.array_intersect("a_h", "b_h"))
    like = common / (F.col("a_n") + F.col("b_n") - common) >= similar
    to_ends = met.select("node", F.explode(F.array("lo", "hi")).alias("end")).where("node != end") \
        .select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()
    tried = written(to_ends.unionAll(covered_pairs(groups)).distinct().join(sided(signs, "a"), "a").join(sided(signs, "b"), "b").where(maybe).select("a", "b", "a_n", "b_n"), paths)
    sets = sets_of(tried.select(F.explode(F.array("a", "b")).alias("node")))
    first = written(tried.join(sided(sets, "a"), "a").join(sided(sets, "b"), "b").where(like).select("a", "b"), paths)
    parts = written(components(first), paths)
    in_part = met.select("key", "node").join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    sizes = in_part.groupBy("key", "part").agg(F.count("*").alias("n"))
    split = sizes.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.count("*").alias("k")).where("k > 1")
    apart = written(in_part.join(split.select("key", "largest"), "key").join(signs, "node"), paths)
    left, right = sided(apart.where("part != largest").drop("largest"), "a"), sided(apart.drop("largest"), "b")
    across_parts = (left["key"] == right["key"]) & (F.col("a_part") != F.col("b_part")) & maybe
    # first who has a candidate at all; then sets go along, so that only links leave the comparison and never its candidates
    left_, right_ = written(left.join(right, across_parts, "left_semi"), paths), written(right.join(left, across_parts, "left_semi"), paths)
    sets = sets_of(left_.select(F.col("a").alias("node")).unionAll(right_.select("b")))
    left_, right_ = left_.join(sided(sets, "a"), "a"), right_.join(sided(sets, "b"), "b")
    across = left_.join(right_, (left_["key"] == right_["key"]) & (F.col("a_part") != F.col("b_part")) & maybe & like).select("a", "b").distinct()
    linked = components(first.unionAll(across))
    roots = groups.select("node", "least").join(linked, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    return rows.select("doc_id", "node"), roots


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """``(doc_id, component_id)``, a row per row of ``docs``: groups of copies that share most five-word shingles.

    See :func:`_grouped`; the component is the smallest id of the group, null where none has one.
    """
    rows, roots = _grouped(docs, text, doc_id, similar, [])
    low = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(roots.join(low, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (a null id comes last); all columns as they were.

    Different texts stay, also where they share an id or have none. Of rows with the same id and the same
    shingles the one whose text comes first stays.
    """
    rows, roots = _grouped(docs, "text", "doc_id", SIMILAR, paths := [])
    held = rows.join(roots.select("node", "root"), "node")
    first = held.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("x"))
    kept = written(first.select("x.doc_id", "x.node"))
    # where ids repeat or lack, the text tells which row is meant; elsewhere the id does
    special = written(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"))
    doubtful = written(rows.select("doc_id").join(kept.select("doc_id"), "doc_id", "left_anti").unionAll(special).distinct())
    forget(docs.sparkSession, paths)
    place, name, node = (f"_{x}_{uuid.uuid4().hex}" for x in ("place", "name", "node"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"])
    # most documents stay and are passed on where they are; only those that may go are looked up
    maybe = id_filter(doubtful, "doc_id")
    plain = docs.where(~maybe("doc_id"))
    asked = docs.where(maybe("doc_id"))
    plain = plain.unionAll(asked.join(doubtful, same(asked, doubtful), "left_anti"))
    # dealt out first, so that no task holds the filter's worker and the names' at a time
    unsure = asked.join(special, same(asked, special), "left_semi").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    unsure = unsure.withColumn(name, set_names()("text"))
    meant = kept.join(special, same(kept, special), "left_semi").select(F.col("doc_id").alias(node), F.col("node").alias(place))
    # null-safe, else Spark asks each name whether it is null, in a worker of its own before the texts are dealt out
    found = unsure.join(meant, unsure["doc_id"].eqNullSafe(meant[node]) & unsure[name].eqNullSafe(meant[place]), "left_semi")
    one = found.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", name).orderBy("text"))).where(F.col(place) == 1)
    return plain.select(docs.columns).unionAll(one.select(docs.columns))


@query("op7_covering_dedup")
def op7(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
