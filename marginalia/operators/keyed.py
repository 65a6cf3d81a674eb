"""Per-key primitives for order-dependent work: previous row, runs, positions, running sums.

Each is a plain window over the key, whatever the key's size, so chained primitives share one
shuffle and one sort and no job runs to look at the data first. A key is one document or one
session: its rows come from one parsed file and pass a task in order, spilling where they must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.session import ensure_checkpoint_dir


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row per key by ``order``.

    An aggregate, not a window: copies collapse before the shuffle, so one hash shared by a
    third of the rows costs each reducer one row per map task.
    """
    columns = df.columns
    sort_key = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    row = F.struct(*[F.col(c) for c in columns])
    return df.groupBy(*keys).agg(F.min_by(row, sort_key).alias("_row")).select(
        *[F.col("_row")[c].alias(c) for c in columns])


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int,
                  rank: str = "rank") -> DataFrame:
    """Best ``n`` rows per key; Spark cuts each task to ``n`` per key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def with_previous(df: DataFrame, keys: list[str], idx: str, cols: list[str]) -> DataFrame:
    """Add ``prev_<col>`` of the row before by ``idx`` and ``first_<idx>`` of the key."""
    names = list(dict.fromkeys([idx, *cols]))
    w = W.partitionBy(*keys).orderBy(idx)
    out = (df.withColumn("_prev", F.lag(F.struct(*[F.col(c) for c in names])).over(w))
           .withColumn(f"first_{idx}", F.first(idx).over(w)))
    return out.withColumns({f"prev_{c}": F.col("_prev")[c] for c in names}).drop("_prev")


def with_run_start(df: DataFrame, keys: list[str], idx: str, boundary: Column, name: str = "run_start") -> DataFrame:
    """Add the ``idx`` of the latest row at or before this one where ``boundary`` holds."""
    w = W.partitionBy(*keys).orderBy(idx).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("_start", F.when(boundary, F.col(idx))).withColumn(name, F.max("_start").over(w)).drop("_start")


def with_running_sum(df: DataFrame, keys: list[str], idx: str, value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows before this one (exclusive prefix sum)."""
    w = W.partitionBy(*keys).orderBy(idx).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def with_position(df: DataFrame, keys: list[str], idx: str, name: str = "position") -> DataFrame:
    """Add the dense 0-based place of a row inside its key."""
    out = with_running_sum(df.withColumn("_one", F.lit(1)), keys, idx, "_one", name)
    return out.withColumn(name, F.col(name).cast("bigint")).drop("_one")


def global_row_number(df: DataFrame, order: list[str], start: int | Column = 0,
                      name: str = "row_id") -> DataFrame:
    """Contiguous ids over the whole table in ``order``, without a single-task sort.

    The table is range-partitioned and sorted, written once to the checkpoint folder (so that
    counts and rows agree even when an executor is lost), counted per partition, and offset.
    Runs one job.
    """
    ensure_checkpoint_dir(df.sparkSession)
    spread = (df.repartitionByRange(*[F.col(o) for o in order])
              .sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
              .checkpoint())
    # one row per partition of the table: bounded by the partition count
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before")))
    first = start if isinstance(start, Column) else F.lit(start)
    return (spread.join(F.broadcast(offsets), "_part")
            .withColumn(name, (first + F.col("_before") + F.col("_pos")).cast("bigint"))
            .drop("_part", "_pos", "_before"))


def pair_up(df: DataFrame, keys: list[str], position: str, eligible: str) -> DataFrame:
    """Choose non-overlapping adjacent pairs greedily from the left.

    ``eligible`` is true on a row that may absorb the next one; ``position`` is dense. Inside
    a run of eligible rows the 1st, 3rd, 5th ... take their successor. Adds ``head``, the
    position of the row each row ends up in.
    """
    flag = F.coalesce(F.col(eligible), F.lit(False))
    df = df.withColumn("_on", flag)
    df = with_previous(df, keys, position, ["_on"])
    opens = F.col("_on") & ~F.coalesce(F.col("prev__on"), F.lit(False))
    df = with_run_start(df, keys, position, opens, "_run")
    even = (F.col(position) - F.col("_run")) % 2 == 0
    # the row after a taken one is swallowed; it directly follows the run or sits inside it
    swallowed = F.coalesce(F.col("prev__on"), F.lit(False)) & ~even
    return (df.withColumn("head", F.when(swallowed, F.col(position) - 1).otherwise(F.col(position)))
            .drop("_on", "prev__on", f"prev_{position}", f"first_{position}", "_run"))
