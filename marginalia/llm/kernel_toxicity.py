"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

The kernel counts common letter subsequences of length 3, each weighted by ``DECAY`` to the power of
the letters it spans, up to ``GAPS`` letters skipped: ``idiot`` still shares most of its
subsequences with ``idxiot`` or ``i.d.i.o.t``. A document is a bag of units (words, runs of single
letters taken together, windows of long words); it is as toxic as its worst unit. Units are single
words, never sentences: an insult made of several ordinary words is not seen. Training is that of a
multiple-instance machine: labels belong to documents, and rounds of fitting decide which unit of a
toxic document carries its label.

In Nyström space a unit's decision is a weighted sum of its kernel values to the landmarks, thus of
its own subsequences: scoring needs one weight per subsequence, whatever the number of landmarks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.calibrate import hinge_machine, logistic, probability
from marginalia.llm.common import held_out, labelled_sample, query, small_batches, table

#: Bound of the labelled sample: documents per class.
PER_CLASS = 1200
DECAY, GAPS, LENGTH = 0.75, 2, 3
#: Landmarks of toxic and of clean units.
LANDMARKS = (96, 96)
ROUNDS = 3
#: Units that stand for a document in training.
WITNESSES = 3
COST = 2000.0
#: Letters of a unit that count; longer ones are cut into overlapping units, so whole texts are read.
UNIT = 40
#: Long unbroken words are also read through windows of so many letters, from this many letters on.
WINDOW, LONG = 7, 16
#: Bounds of a fit: units of either side, and units among which landmarks are sought.
TOXIC_UNITS, CLEAN_UNITS, SOUGHT = 4000, 8000, 1200
#: A unit that clean documents hold too can stand for a toxic one when it is more usual there by so many deviations.
SURELY = 3.0
#: Units whose decision a task remembers; a full memo is emptied, results do not change.
MEMO = 200_000
#: Units of either side of a kernel matrix that are worked out at a time.
BLOCK = 128
THRESHOLD = 0.5

SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
EDGES = ".,;:!?\"'()[]{}<>|*%#&~`^_=+-/\\…»«“”‘’"


def units(words: list[str]) -> Iterator[str]:
    """Words without punctuation at their edges, also read without inner signs, long ones in overlapping pieces;
    runs of single letters joined."""
    run: list[str] = []
    for word in words:
        w = word.strip(EDGES)
        if not w:
            continue  # signs standing alone part no letters
        if len(w) == 1:
            run.append(w)
            continue
        if run:
            yield "".join(run)
            run = []
        if len(w) <= UNIT:
            yield w
            if not w.isalnum() and len(bare := "".join(filter(str.isalpha, w))) > 1:
                yield bare  # signs between letters are left out in a second reading
        else:
            for i in range(0, len(w) - UNIT // 2, UNIT // 2):
                yield w[i:i + UNIT]
        if len(w) >= LONG:
            for i in range(len(w) - WINDOW + 1):
                yield w[i:i + WINDOW]
    for i in range(0, max(0, len(run) - UNIT // 2) or bool(run), UNIT // 2):
        yield "".join(run[i:i + UNIT])


def _subsequences(batch: list[str]):
    """Arrays ``(unit, code, weight)``: each subsequence of each unit once, its weights added; unit norms."""
    import numpy as np

    # a start and an end mark, so that how a word begins and ends counts
    sizes = np.array([len(u) + 2 for u in batch])
    chars = np.frombuffer("".join(f"\x02{u}\x03" for u in batch).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(batch)), sizes)
    place = np.arange(len(chars)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    left = sizes[owner] - place  # letters from here to the unit's end
    rows, codes, weights = [], [], []
    for b in range(2, LENGTH + GAPS):
        here = np.flatnonzero(left > b)
        for a in range(1, b):
            rows.append(owner[here])
            codes.append((chars[here] << 42) | (chars[here + a] << 21) | chars[here + b])
            weights.append(np.full(len(here), DECAY ** (b + 1)))
    rows, codes, weights = (np.concatenate(x) for x in (rows, codes, weights))
    order = np.lexsort((codes, rows))
    rows, codes, weights = rows[order], codes[order], weights[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])]) if len(rows) else np.array([], dtype=int)
    weights = np.add.reduceat(weights, first) if len(first) else weights
    rows, codes = rows[first], codes[first]
    norms = np.sqrt(np.bincount(rows, weights ** 2, minlength=len(batch)))
    return rows, codes, weights, np.maximum(norms, 1e-12)


def kernel(left: list[str], right: list[str]):
    """Normalised kernel matrix of two lists of units."""
    import numpy as np

    if len(left) > BLOCK:  # bounded memory, also for many long units on either side
        return np.vstack([kernel(left[i:i + BLOCK], right) for i in range(0, len(left), BLOCK)])
    if len(right) > BLOCK:
        return np.hstack([kernel(left, right[i:i + BLOCK]) for i in range(0, len(right), BLOCK)])
    r1, c1, w1, n1 = _subsequences(left)
    r2, c2, w2, n2 = _subsequences(right)
    named, at = np.unique(c2, return_inverse=True)
    side = np.zeros((len(named) + 1, len(right)))
    side[at, r2] = w2 / n2[r2]
    found = np.searchsorted(named, c1)
    found[(found == len(named)) | (named[np.minimum(found, len(named) - 1)] != c1)] = len(named)
    keep = found < len(named)
    out = np.zeros((len(left), len(right)))
    rows = r1[keep]  # in order
    if len(rows):
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[first]] = np.add.reduceat((w1[keep] / n1[rows])[:, None] * side[found[keep]], first)
    return out


@dataclass
class Model:
    """Subsequence codes in order, their weights, the bias; the calibration."""

    codes: object
    weights: object
    bias: float
    slope: float
    intercept: float


def decisions(model: Model, batch: list[str]):
    """The machine's value for each unit."""
    import numpy as np

    if not batch or not len(model.codes):
        return np.full(len(batch), model.bias)
    rows, codes, weights, norms = _subsequences(batch)
    found = np.minimum(np.searchsorted(model.codes, codes), len(model.codes) - 1)
    hit = model.codes[found] == codes
    return np.bincount(rows[hit], weights[hit] * model.weights[found[hit]], minlength=len(batch)) / norms + model.bias


def worst(model: Model, text: str | None, memo: dict[str, float]) -> float:
    """The largest decision over the units of all sentences; the bias for a text without any."""
    found = set(units((text or "").lower().split()))
    if not found:
        return model.bias
    new = [u for u in found if u not in memo]
    if new:
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(found)
        for i in range(0, len(new), 4096):
            part = new[i:i + 4096]
            memo.update(zip(part, decisions(model, part).tolist()))
    return max(map(memo.__getitem__, found))


def _diverse(batch: list[str], most: int) -> list[str]:
    """Units far from each other by the kernel, the first one first."""
    import numpy as np

    if len(batch) <= most:
        return batch
    batch = batch[:SOUGHT]
    k = kernel(batch, batch)
    near, picked = k[0].copy(), [0]
    while len(picked) < most:
        i = int(np.argmin(near))
        picked.append(i)
        near = np.maximum(near, k[i])
    return [batch[i] for i in picked]


def _evidence(bags: list[set[str]], signs: list[int]) -> dict[str, float]:
    """A first guess per unit: how surely its most telling run of five letters means a toxic document."""
    import math
    from collections import Counter

    seen = {0: Counter(), 1: Counter()}
    grams = lambda u: {f"\x02{u}\x03"[i:i + 5] for i in range(max(1, len(u) - 2))}
    for y in (1, 0):
        for bag in (b for b, sign in zip(bags, signs) if sign == y):
            found = {g for u in bag for g in grams(u)}
            seen[y].update(found if y else found & seen[1].keys())  # others say nothing of toxic text
    n = Counter(signs)

    def sure(g: str) -> float:
        a, b = seen[1][g] + 0.5, seen[0][g] + 0.5
        return (math.log(a / (n[1] + 1)) - math.log(b / (n[0] + 1))) / math.sqrt(1 / a + 1 / b)

    known = {g: sure(g) for g in seen[1]}
    return {u: max(known.get(g, -9.0) for g in grams(u)) for u in set().union(*bags)} if bags else {}


def _machine(toxic: dict[str, int], clean: dict[str, int]) -> Model:
    """SVM on Nyström features of landmarks from both sides, folded into weights per subsequence."""
    import numpy as np

    marks = list(dict.fromkeys(_diverse(list(toxic), LANDMARKS[0]) + _diverse(list(clean), LANDMARKS[1])))
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])  # K^(-1/2) on the kept directions
    rows = np.vstack([kernel(list(toxic), marks), kernel(list(clean), marks)]) @ root
    w = hinge_machine(rows, [1] * len(toxic) + [-1] * len(clean), [*toxic.values(), *clean.values()], COST)
    each = root @ w[:-1]
    r, c, weight, norm = _subsequences(marks)
    codes, at = np.unique(c, return_inverse=True)
    return Model(codes, np.bincount(at, weight / norm[r] * each[r]), float(w[-1]), 0.0, 0.0)


def train(sample: list[tuple[int, str]]) -> Model:
    """A model of labelled texts ``(toxic 0/1, text)``; without both classes every score is the share of label 1."""
    import math
    from collections import Counter

    import numpy as np

    signs = [y for y, _ in sample]
    nothing = Model(np.array([], dtype=np.int64), np.array([]), 0.0, *logistic([], signs))
    if len(set(signs)) < 2:
        return nothing
    bags = [{u for sentence in SENTENCE.split(t.lower()) for u in units(sentence.split())} for _, t in sample]
    fitted = [i for i in range(len(sample)) if i % 4]
    rest = [i for i in range(len(sample)) if not i % 4] if len(sample) >= 400 else fitted
    guess = _evidence([bags[i] for i in fitted], [signs[i] for i in fitted])
    said = Counter(u for i in fitted if signs[i] for u in bags[i])
    said_clean = Counter(u for i in fitted if not signs[i] for u in bags[i] if u in said)
    n = Counter(signs[i] for i in fitted)
    # how much more usual a unit is in toxic documents than in clean ones: wrong labels do not decide alone
    odds = {u: (k + 0.5) * (n[0] + 1) / ((said_clean[u] + 0.5) * (n[1] + 1)) for u, k in said.items()}
    share = lambda u: odds.get(u, 0.0) / (1 + odds.get(u, 0.0))
    good = [bags[i] for i in fitted if not signs[i] and bags[i]]

    def surely(u: str) -> bool:
        """By the likelihood ratio against being as usual in both; few clean occurrences weigh little."""
        a, b = said[u], said_clean[u]
        even = (a + b) / (n[0] + n[1])
        return odds[u] > 1 and 2 * (a * math.log(a / (even * n[1])) + b * math.log(b / (even * n[0]))) >= SURELY ** 2

    telling = {u for u in said if not said_clean[u] or surely(u)}
    bad = [bags[i] & telling or bags[i] for i in fitted if signs[i] and bags[i]]
    if not good or not bad:
        return nothing
    value, least = guess.get, 3.0
    order = lambda bag: sorted(bag, key=lambda u: (-value(u, -9.0), u))
    every = list(set().union(*bags))
    for _ in range(ROUNDS):
        # each toxic document's worst units stand for it; of clean ones the worst and some others do
        worst_units = [order(bag)[:WITNESSES] for bag in bad]
        toxic = Counter(u for found in worst_units for k, u in enumerate(found) if value(u, -9.0) > least)
        if not toxic:
            toxic = Counter(found[0] for found in worst_units)
        clean = Counter(u for bag in good for u in order(bag)[:WITNESSES])
        clean.update(u for bag in good for u in sorted(bag, key=lambda u: (hash_of(u), u))[:WITNESSES])
        for u, times in list(toxic.items()):  # spellings with a letter put in stand for the word too
            if times >= 3 and len(u) >= 4:
                for k in range(2, len(u) - 1):
                    toxic[f"{u[:k]}x{u[k:]}"] += max(1, times // 10)
        for u in toxic.keys() & odds.keys():
            toxic[u] *= share(u)
        for u in clean.keys() & odds.keys():
            clean[u] *= 1 - share(u)
        model = _machine(dict(toxic.most_common(TOXIC_UNITS)), dict(clean.most_common(CLEAN_UNITS)))
        value = dict(zip(every, np.concatenate([decisions(model, every[i:i + 8192]) for i in range(0, len(every), 8192)]).tolist())).get
        least = 0.0
    top = [max((value(u, model.bias) for u in bags[i]), default=model.bias) for i in rest]
    model.slope, model.intercept = logistic(np.clip(top, -1.5, 1.5), [signs[i] for i in rest])
    return model


def hash_of(text: str) -> int:
    """A fixed pseudo-random order of units."""
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Train on a bounded labelled sample, then shift the intercept to the shares of the classes in all labels."""
    import math

    sample = labelled_sample(docs, labels, label, per_class)
    model = train(sample)
    total = {y: labels.where(F.col(label) == y).where(~held_out()).count() for y in (0, 1)}
    taken = {y: sum(k == y for k, _ in sample) for y in (0, 1)}
    if model.slope and all(total.values()):
        model.intercept += math.log(total[1] / total[0]) - math.log(taken[1] / taken[0])
    return model


def scorer(model: Model):
    """Column function ``text -> score`` from 0 to 1, higher for toxic text; null and empty texts get a score too."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, float] = {}
        for texts in batches:
            yield pd.Series([probability(min(1.5, max(-1.5, worst(model, t, memo))), model.slope, model.intercept) for t in texts],
                            dtype="float64")

    return score


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns as they were."""
    small_batches(docs.sparkSession)
    return docs.where(scorer(model)(F.col("text")) < threshold)


@query("op4_kernel_toxicity")
def op4(spark, sf_dir):
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", scorer(model)(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
