"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that the one before it kept;
results are written as Parquet to the shared folder and read again. Models are trained on the
labelled documents of ``sf_dir``, never on held-out ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import compression_quality, covering_dedup, curve_packing, kernel_toxicity, pseudonyms
from marginalia.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    model = compression_quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return compression_quality.accepted(docs, model)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel classifier rejects go."""
    model = kernel_toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return kernel_toxicity.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return covering_dedup.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses get pseudonyms; the character count follows the text."""
    out = pseudonyms.pseudonymise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens along the curve."""
    import public_tokenizers as public

    return curve_packing.pack(docs, public.path("byte_bpe_50k.json"), public.PATTERN)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("private", private), ("packing", packing)]

#: Compression, kernels and tokenizers are not expressible in SQL; a test compares with a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
