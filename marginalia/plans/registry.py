"""Registry of queries: name, Spark form, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Result columns in types every SQL engine has: 64-bit numbers, text, local timestamps."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (ST.IntegerType, ST.ShortType, ST.ByteType)):
            c = c.cast("bigint")
        elif isinstance(t, (ST.FloatType, ST.DecimalType)):
            c = c.cast("double")
        elif isinstance(t, ST.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(t, ST.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
        if isinstance(t, (ST.DoubleType, ST.FloatType, ST.DecimalType)):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` its rows are checked by a unit test only."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf: plain(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
