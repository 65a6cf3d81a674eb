"""Tables that grow batch by batch: added rows and tombstones on top of a base, merged when read.

A folder holds, for each of its tables, ``<table>/seq=N/part=P`` (what batch N added and ended) and
``<table>_base/upto=N/part=P`` (what was live after batch N), and ``_done``: a row per committed
batch and per base. Readers see what ``_done`` names, so a batch or a compaction that was killed
changes nothing for them. A row is found by its partition, a hash of the table's columns for that.
One writer at a time, any number of readers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import folder_exists

PARTS = 256
#: Tasks, and files, that one partition of a base is spread over.
SPREAD = 16
DONE = "seq bigint, stream string, batch_id bigint, parts int, base boolean"
MARKS = "_alive boolean, seq bigint, part int"


@dataclass(frozen=True)
class Table:
    """A table of a log: its columns, those that identify a row, and those that decide its partition."""
    name: str
    schema: str
    key: tuple[str, ...]
    by: tuple[str, ...]


class BatchLog:
    """One folder of tables, as its committed batches leave them when it is opened."""

    def __init__(self, spark: SparkSession, folder: str, tables: list[Table], parts: int = PARTS):
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), {t.name: t for t in tables}
        r = self._done().agg(F.max("seq").alias("last"), F.max(F.when(F.col("base"), F.col("seq"))).alias("base"), F.max("parts").alias("parts")).first()
        self.last = -1 if r.last is None else r.last  # the last committed batch
        self.base = -1 if r.base is None else r.base  # the batch that the base goes up to
        self.parts = r.parts or parts  # fixed by the first commit

    def _parquet(self, path: str, schema: str) -> DataFrame:
        if not folder_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _done(self) -> DataFrame:
        return self._parquet(f"{self.folder}/_done", DONE)

    def holds(self, stream: str, batch_id: int) -> bool:
        """Whether that batch of that stream is committed."""
        return not self._done().where((F.col("stream") == stream) & (F.col("batch_id") == batch_id)).isEmpty()

    def part(self, *columns: str | Column) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.parts)).cast("int")

    def parts_of(self, rows: DataFrame, *columns: str) -> list[int]:
        """Partitions in which rows with these columns lie; at most as many numbers as the log has partitions."""
        return sorted(r[0] for r in rows.select(self.part(*columns)).distinct().collect())

    def rows(self, table: str, within: list[int] | None = None) -> DataFrame:
        """All rows and tombstones of committed batches since the base, and the base; only some partitions if given."""
        t = self.tables[table]
        found = self._parquet(f"{self.folder}/{table}", f"{t.schema}, {MARKS}").where(
            (F.col("seq") > self.base) & (F.col("seq") <= self.last))
        if self.base >= 0:
            base = self._parquet(f"{self.folder}/{table}_base/upto={self.base}", f"{t.schema}, part int")
            found = found.unionByName(base.withColumns({"_alive": F.lit(True), "seq": F.lit(self.base).cast("bigint")}))
        return found if within is None else found.where(F.col("part").isin(within))

    def live(self, table: str, within: list[int] | None = None) -> DataFrame:
        """Rows that no later batch ended. A row may be ended and added anew by one batch, which replaces it."""
        t, rows = self.tables[table], self.rows(table, within)
        alive = rows.where("_alive").drop("_alive")
        if self.last > self.base:  # only batches hold tombstones
            ended = rows.where("NOT _alive").select(F.col("seq").alias("_ended"), *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(t.key)])
            same = [F.col(k) == F.col(f"_key_{i}") for i, k in enumerate(t.key)]
            alive = alive.join(ended, reduce(Column.__and__, same, F.col("_ended") > F.col("seq")), "left_anti")
        return alive.drop("seq", "part")

    def write(self, table: str, added: DataFrame, ended: DataFrame | None = None, more: bool = False) -> None:
        """Write what the next batch adds to and ends in a table, or more of it; a try that was not committed is overwritten."""
        t = self.tables[table]
        columns = self.spark.createDataFrame([], t.schema).columns
        rows = added.select(*columns).withColumn("_alive", F.lit(True))
        if ended is not None:
            rows = rows.unionByName(ended.select(*t.key).withColumn("_alive", F.lit(False)), allowMissingColumns=True)
        # a partition goes to as many tasks as its size takes, small ones share a task
        rows.withColumn("part", self.part(*t.by)).hint("rebalance", F.col("part")).write.mode("append" if more else "overwrite").option(
            "compression", "zstd").partitionBy("part").parquet(f"{self.folder}/{table}/seq={self.last + 1}")

    def written(self, table: str) -> DataFrame:
        """What ``write`` has written of a table for the next batch."""
        t = self.tables[table]
        return self._parquet(f"{self.folder}/{table}/seq={self.last + 1}", f"{t.schema}, _alive boolean, part int").drop("part")

    def _mark(self, seq: int, stream: str, batch_id: int, base: bool) -> None:
        self.spark.createDataFrame([(seq, stream, batch_id, self.parts, base)], DONE).coalesce(1).write.mode("append").parquet(f"{self.folder}/_done")

    def commit(self, stream: str, batch_id: int) -> None:
        """Show the next batch to readers: one row, one file."""
        self._mark(self.last + 1, stream, batch_id, False)
        self.last += 1

    def _write_base(self, table: str, rows: DataFrame, upto: int) -> None:
        t = self.tables[table]
        spread = F.pmod(F.xxhash64(*t.key, F.lit(1)), F.lit(SPREAD))
        rows.withColumns({"part": self.part(*t.by), "_spread": spread}).repartition("part", "_spread").drop("_spread").write.mode(
            "overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{self.folder}/{table}_base/upto={upto}")

    def compact(self) -> None:
        """Write the live rows of all tables as a new base, then point readers to it; batches of meanwhile stay on top."""
        if self.last == self.base:
            return
        for name in self.tables:
            self._write_base(name, self.live(name), self.last)
        self._mark(self.last, "", -1, True)
        self.base = self.last

    def replace(self, rows: dict[str, DataFrame]) -> None:
        """Put other rows in place of all tables' rows: a new base after the last batch."""
        for name, df in rows.items():
            self._write_base(name, df, self.last + 1)
        self._mark(self.last + 1, "", -1, True)
        self.last = self.base = self.last + 1

    def vacuum(self) -> None:
        """Delete the folders that readers opened from now on do not use: batches up to the base, older bases."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for name in self.tables:
            for path, last in ((f"{name}/seq=*", self.base), (f"{name}_base/upto=*", self.base - 1)):
                where = hadoop(f"{self.folder}/{path}")
                fs = where.getFileSystem(conf)
                for found in fs.globStatus(where) or []:
                    if int(found.getPath().getName().split("=")[1]) <= last:
                        fs.delete(found.getPath(), True)
