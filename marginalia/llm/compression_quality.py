"""Quality by compression: dictionaries of good and of bad labelled text, and which of them helps a text more.

Text that repeats itself is small under any dictionary, so their difference says little of it: the
score weighs the difference together with the compressed size and the length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import mul

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.calibrate import logistic_many, probability
from marginalia.llm.common import held_out, labelled_sample, query, small_batches, table

#: Bound of the labelled sample: documents per class.
PER_CLASS = 1500
#: Bytes compressed at a time, so that a dictionary counts all through a long text.
SEGMENT = 2048
DICTIONARY = 128 * 1024
LEVEL = 3
#: A text counts as having so many more bytes of average text: little evidence moves a score little.
PRIOR_BYTES = 96
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    average: float
    weights: list[float]
    intercept: float


def _segments(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i:i + SEGMENT] for i in range(0, len(raw), SEGMENT)]


def _dictionaries(one: list[str], two: list[str]) -> tuple[bytes, bytes]:
    """A dictionary of each side; raw bytes, as many of either, where a side is too small to train one."""
    import zstandard as zs

    sides = [[s for t in texts for s in _segments(t)] for texts in (one, two)]
    least = min(sum(map(len, samples)) for samples in sides)
    if least > 4 * DICTIONARY and min(map(len, sides)) >= 100:
        return tuple(zs.train_dictionary(DICTIONARY, samples).as_bytes() for samples in sides)
    return tuple(b"".join(samples)[:min(least, DICTIONARY)] for samples in sides)


def _compressor(dictionary: bytes):
    import zstandard as zs

    held = zs.ZstdCompressionDict(dictionary) if dictionary else None  # trained or raw, told by its first bytes
    if held is not None:
        held.precompute_compress(level=LEVEL)
    return zs.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)


def sizes(good, bad, text: str | None) -> tuple[int, int, int]:
    """Bytes of the text compressed with either dictionary, and its own bytes."""
    parts = _segments(text)
    return sum(len(good.compress(p)) for p in parts), sum(len(bad.compress(p)) for p in parts), sum(map(len, parts))


def measures(good: int, bad: int, size: int, average: float) -> list[float]:
    """What a score weighs: bytes that the good dictionary saves per byte of text, the compressed share, the length, and products.

    Little text counts as average in the first; an empty text as not compressible.
    """
    import math

    gain = (bad - good + average * PRIOR_BYTES) / (size + PRIOR_BYTES)
    share, length = good / size if size else 1.0, math.log(size + 1)
    return [gain, share, length, gain * share, gain * length, share * length]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Dictionaries from half of a bounded sample, calibration on the other half.

    Without texts of both classes there is nothing to compare: every score is then the share of
    label 1, one half where there are no labels at all.
    """
    sample = labelled_sample(docs, labels, label, per_class)
    by_class = {y: [t for k, t in sample if k == y] for y in (0, 1)}
    fitted = {y: texts[0::2] for y, texts in by_class.items()}
    rest = [(y, t) for y, texts in by_class.items() for t in texts[1::2]]
    good, bad = _dictionaries(fitted[1], fitted[0])
    if not good or not bad:
        return Model(b"", b"", 0.0, [], logistic_many([], [y for y, _ in sample])[1])
    one, two = _compressor(good), _compressor(bad)
    sized = [(y, sizes(one, two, t)) for y, t in rest]
    clean = sorted((b - a) / (n + PRIOR_BYTES) for y, (a, b, n) in sized if y == 1) or [0.0]
    average = clean[len(clean) // 2]
    weights, intercept = logistic_many([measures(*n, average) for _, n in sized], [y for y, _ in sized])
    total = {y: labels.where(F.col(label) == y).where(~held_out()).count() for y in (0, 1)}
    taken = {y: sum(k == y for k, _ in rest) for y in (0, 1)}
    if any(weights) and all(total.values()):  # the sample holds the classes evenly, the corpus does not
        import math
        intercept += math.log(total[1] / total[0]) - math.log(taken[1] / taken[0])
    return Model(good, bad, average, weights, intercept)


def scorer(model: Model):
    """Column function ``text -> score`` from 0 to 1, higher for good text; null and empty texts get a score too."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        good, bad = _compressor(model.good), _compressor(model.bad)
        for texts in batches:
            values = (sum(map(mul, model.weights, measures(*sizes(good, bad, t), model.average))) for t in texts)
            yield pd.Series([probability(v, 1.0, model.intercept) for v in values], dtype="float64")

    return score


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, columns as they were."""
    small_batches(docs.sparkSession)
    return docs.where(scorer(model)(F.col("text")) >= threshold)


@query("op2_compression_quality")
def op2(spark, sf_dir):
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", scorer(model)(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
