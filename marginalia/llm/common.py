"""What the corpus operators share: session settings, shared folder, written intermediates, labelled samples."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch: texts may be long, so batches are kept small.
BATCH_ROWS = 512

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame``; ``sql`` gives the same rows where SQL can."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of long texts can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a local session gets a scratch folder; a cluster gets an error, since a
    machine-local folder would lose data.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="run-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows written once to the shared folder, lineage cut; for narrow intermediates."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """Like :func:`checkpointed`, as compressed Parquet; for wide intermediates.

    ``paths`` gets the folder, for :func:`forget`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.parquet(path)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediates that no result reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    paths.clear()


#: Bits of a filter of ids, and of a row of it.
FILTER_BITS, BLOCK_BITS = 1 << 23, 1 << 15


def id_bitmap(ids: DataFrame, column: str):
    """``(place, marked)``: a column function ``id -> place``, and a test of an array of places, true for all of ``ids``
    and few others; a null is an id too.

    A bitmap of bounded size (1 MB) that tasks build and the driver ships, however many ids there
    are. Where it fills up it is true for more others, so what it lets through is to be compared.
    """
    import numpy as np

    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = ids.select((place(column) + 1).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("block")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    whole = np.zeros((FILTER_BITS // BLOCK_BITS, BLOCK_BITS // 8), dtype=np.uint8)
    for r in bits.collect():  # a row per block
        whole[r.block - 1] = np.frombuffer(r.bits, dtype=np.uint8)
    shipped = ids.sparkSession.sparkContext.broadcast(whole.tobytes())

    def marked(at):
        return (np.frombuffer(shipped.value, dtype=np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    return place, marked


def id_filter(ids: DataFrame, column: str):
    """Column function ``id -> boolean``, as :func:`id_bitmap` marks the ids."""
    place, marked = id_bitmap(ids, column)

    @F.pandas_udf("boolean")
    def maybe(p: pd.Series) -> pd.Series:
        return pd.Series(marked(p.to_numpy()))

    return lambda c: maybe(place(c))


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents whose labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> list[tuple[int, str]]:
    """``(label, text)`` of at most ``per_class`` labelled documents of each class, for fitting on the driver.

    The bound holds whatever the table's size: ids are picked in hash order from the narrow label
    table, held-out ids never, and only their texts are read. Conflicting or repeated label rows of
    an id fold to the largest label; null labels and null texts take no part.
    """
    known = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    texts = (docs.select("doc_id", "text").where(F.col("text").isNotNull())
             .join(F.broadcast(picked), "doc_id")  # at most 2 * per_class ids
             .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")))
    rows = texts.select("doc_id", "y", "text").collect()
    return [(r.y, r.text) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]
