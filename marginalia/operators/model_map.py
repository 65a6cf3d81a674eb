"""Calling a user's model from Spark tasks: batches, retries, fallbacks and a result cache."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_PREFIX = 500
RESULT_FIELDS = "success boolean, data string, error string, retries int, model string, fallback boolean"


def call_with_fallback(models: Sequence[tuple[str, Callable[[str], str]]], prompt: str, retries: int = 3,
                       base: float = 1.0, factor: float = 2.0, ceiling: float = 30.0,
                       sleep: Callable[[float], None] = time.sleep) -> dict:
    """One prompt through a chain of models, each retried with exponential backoff."""
    error, used = None, ""
    for place, (name, fn) in enumerate(models):
        used = name
        for attempt in range(retries + 1):
            try:
                return {"success": True, "data": fn(prompt), "error": None, "retries": attempt,
                        "model": name, "fallback": place > 0}
            except Exception as e:  # a model may fail in any way
                error = str(e)
                if attempt < retries:
                    sleep(min(base * factor ** attempt, ceiling))
    return {"success": False, "data": None, "error": error, "retries": retries, "model": used,
            "fallback": len(models) > 1}


def model_map(df: DataFrame, prompt: str, key: str, models: Sequence[tuple[str, Callable[[str], str]]],
              cache: DataFrame | None = None, retries: int = 3, base: float = 1.0) -> DataFrame:
    """``(key, success, data, error, retries, model, fallback)`` for each row's prompt.

    Filter before this call: Catalyst cannot push a filter through it. ``cache(prompt_md5,
    data)``, keyed by the md5 of the first 500 prompt characters, answers prompts every model
    failed on; it is joined, so it may be of any size.
    """
    asked = df.select(key, F.col(prompt).alias("_prompt"))
    kind = df.schema[key].dataType.simpleString()
    chain = list(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [call_with_fallback(chain, p, retries, base) for p in b["_prompt"]]
            out = pd.DataFrame(rows, columns=["success", "data", "error", "retries", "model", "fallback"])
            out.insert(0, key, b[key].to_numpy())
            out.insert(1, "_prompt", b["_prompt"].to_numpy())
            yield out

    done = asked.mapInPandas(run, f"`{key}` {kind}, _prompt string, {RESULT_FIELDS}")
    if cache is not None:
        done = done.withColumn("prompt_md5", F.md5(F.left("_prompt", F.lit(CACHE_PREFIX)))).join(
            cache.groupBy("prompt_md5").agg(F.min("data").alias("_cached")), "prompt_md5", "left")  # one answer per hash
        use = ~F.col("success") & F.col("_cached").isNotNull()
        done = (done.withColumn("data", F.when(use, F.col("_cached")).otherwise(F.col("data")))
                .withColumn("model", F.when(use, "cache").otherwise(F.col("model")))
                .withColumn("fallback", use | F.col("fallback"))
                .withColumn("error", F.when(~use, F.col("error")))
                .withColumn("success", use | F.col("success")).drop("_cached", "prompt_md5"))
    return done.drop("_prompt")


def vision_map(images: DataFrame, models: Sequence[tuple[str, Callable[[bytes], str]]], retries: int = 3,
               base: float = 1.0) -> DataFrame:
    """The same over image bytes as read by ``spark.read.format('binaryFile')``."""
    chain = list(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [call_with_fallback(chain, c, retries, base) for c in b["content"]]
            out = pd.DataFrame(rows, columns=["success", "data", "error", "retries", "model", "fallback"])
            out.insert(0, "path", b["path"].to_numpy())
            yield out

    return images.select("path", "content").mapInPandas(run, f"path string, {RESULT_FIELDS}")
