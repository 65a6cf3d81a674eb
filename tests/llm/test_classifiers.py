import math
import random

import pytest

from marginalia.llm import calibrate, common, compression_quality as Q, kernel_toxicity as K


def prose(rnd, n):
    parts = ["an", "er", "the", "ou", "ing", "re", "to", "hat", "nd", "is"]
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def made(spark):
    """300 labelled documents: bad ones shout or repeat, toxic ones hold an insult, some with a letter put in."""
    rnd, rows, labels = random.Random(5), [], []
    for i in range(300):
        bad, toxic = i % 3 == 0, i % 4 == 1
        text = prose(rnd, rnd.randint(30, 200))
        if bad:
            text = text.upper().replace(" ", "!! ") if i % 2 else " ".join(w for w in text.split()[:9] for _ in range(12))
        if toxic:
            words = text.split()
            words.insert(rnd.randrange(len(words)), rnd.choice(["wazzock", "numpty", "wazzoxck", "numxpty"]))
            text = " ".join(words)
        rows.append((i, text, "en", "src0", len(text), 0.5))
        labels.append((i, 0 if bad else 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def check(spark, module, fit, label, made, threshold):
    docs, labels, rows, truth = made
    model = fit(docs, labels)
    got = {r.doc_id: r.s for r in docs.select("doc_id", module.scorer(model)("text").alias("s")).collect()}
    y = {r[0]: r[label] for r in truth}
    held = [i for i in got if common.is_held_out(i)]
    right = sum((got[i] >= threshold) == bool(y[i]) for i in held)
    assert right >= 0.9 * len(held)
    assert all(0 <= s <= 1 for s in got.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 300_000), (4, "\n "), (4, "\n ")], "doc_id long, text string")
    scored = odd.select("doc_id", module.scorer(model)("text").alias("s")).collect()
    assert len(scored) == 5 and all(0 <= r.s <= 1 for r in scored)
    kept = module.accepted(docs, model)
    assert kept.columns == docs.columns
    low = label == 2
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if (s < threshold if low else s >= threshold)}
    assert module.accepted(docs.limit(0), model).collect() == []


def test_quality(spark, made):
    check(spark, Q, Q.fit, 1, made, Q.THRESHOLD)


def test_toxicity(spark, made):
    check(spark, K, K.fit, 2, made, K.THRESHOLD)


@pytest.mark.parametrize("module,label", [(Q, "quality"), (K, "toxic")])
def test_labels_of_one_class_null_or_none(spark, made, module, label):
    docs, labels, _, _ = made
    for some in (labels.where(f"{label} = 1"), labels.limit(0), labels.selectExpr("doc_id", f"cast(null as int) {label}"),
                 labels.unionAll(labels).where(f"{label} = 0")):
        model = module.fit(docs, some)
        s = [r.s for r in docs.limit(5).select(module.scorer(model)("text").alias("s")).collect()]
        assert len(set(s)) == 1 and 0 <= s[0] <= 1
    model = module.fit(docs.limit(0), labels)
    assert docs.limit(1).select(module.scorer(model)("text").alias("s")).first().s is not None


def test_held_out_labels_are_never_learned(spark, made):
    docs, labels, _, _ = made
    sample = common.labelled_sample(docs, labels, "toxic", 1000)
    texts = {r.text: r.doc_id for r in docs.collect()}
    assert sample and not any(common.is_held_out(texts[t]) for _, t in sample)
    held = {r.doc_id for r in docs.where(common.held_out()).select("doc_id").collect()}
    assert held == {i for i in range(300) if common.is_held_out(i)}
    assert len(common.labelled_sample(docs, labels, "toxic", 7)) == 14


def brute_kernel(s, t):
    """The kernel by listing all subsequences."""
    def subs(w):
        w, out = f"\x02{w}\x03", {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + K.LENGTH + K.GAPS)):
                    key = w[i] + w[j] + w[k]
                    out[key] = out.get(key, 0.0) + K.DECAY ** (k - i + 1)
        return out
    a, b = subs(s), subs(t)
    dot = lambda x, y: sum(v * y.get(k, 0.0) for k, v in x.items())
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))


def test_kernel_equals_listing():
    words = ["idiot", "idxiot", "aaaaaa", "straße", "北京人", "x" * 40, "ab"]
    got = K.kernel(words, words)
    for i, s in enumerate(words):
        for j, t in enumerate(words):
            assert got[i, j] == pytest.approx(brute_kernel(s, t), abs=1e-9)
    assert K.kernel(["idxiot"], ["idiot"])[0, 0] > 3 * K.kernel(["other"], ["idiot"])[0, 0]


def test_a_large_kernel_is_worked_out_in_blocks():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    whole = K.kernel(words, words)
    assert whole.shape == (300, 300)
    for i, j in ((0, 299), (130, 5), (299, 131), (127, 128)):
        assert whole[i, j] == pytest.approx(brute_kernel(words[i], words[j]), abs=1e-9)


def test_units_read_whole_texts():
    assert list(K.units("The i d i o t s-c-u-m!".lower().split())) == ["the", "idiot", "s-c-u-m", "scum"]
    long = "".join(chr(97 + i % 26) for i in range(1000))
    assert all(long[i:i + 15] in " ".join(K.units([long])) for i in range(0, 985))
    assert list(K.units([])) == []
    assert "".join(dict.fromkeys("".join(K.units(list("abcdefghij" * 10)))))


def test_calibration():
    slope, intercept = calibrate.logistic([0, 1, 2, 3, 4, 5], [0, 0, 1, 0, 1, 1])
    assert slope > 0 and calibrate.probability(0, slope, intercept) < 0.3 < 0.7 < calibrate.probability(5, slope, intercept)
    assert calibrate.logistic([], []) == (0.0, 0.0)


@pytest.mark.parametrize("module,query,label,cut", [(Q, "op2", "quality", 0.3), (K, "op4", "toxic", 0.5)])
def test_query(spark, module, query, label, cut):
    sf = "/root/testdata/sf0.01"
    rows = getattr(module, query)(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(rows) == docs and all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in rows)
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in rows if r.held_out} == {r.doc_id for r in rows if common.is_held_out(r.doc_id)}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.85 * len(held)


def test_quality_weighs_what_zstandard_gives(spark, made):
    """Scores from plain compressor calls and the formula, part by part."""
    import zstandard as zs
    docs, labels, _, _ = made
    model = Q.fit(docs, labels)
    texts = [r.text for r in docs.limit(40).collect()] + ["", None, "repeat. " * 900, "ü" * 5000, "a|b|c " * 3]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in rows.select("text", Q.scorer(model)("text").alias("s")).collect():
        raw = (r.text or "").encode()
        parts = [raw[i:i + 2048] for i in range(0, len(raw), 2048)]
        sizes = [sum(len(zs.ZstdCompressor(level=3, dict_data=zs.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False).compress(p))
                     for p in parts) for d in (model.good, model.bad)]
        n = len(raw)
        gain = (sizes[1] - sizes[0] + model.average * 96) / (n + 96)
        share, length = sizes[0] / n if n else 1.0, math.log(n + 1)
        z = model.intercept + sum(w * x for w, x in zip(model.weights, (gain, share, length, gain * share, gain * length, share * length)))
        assert r.s == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_bad_documents_are_found(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = docs.join(labels, "doc_id").where(common.held_out())
    model = Q.fit(docs, labels)
    got = held.select("quality", (Q.scorer(model)("text") >= Q.THRESHOLD).alias("good")).collect()
    bad, good = [r.good for r in got if r.quality == 0], [r.good for r in got if r.quality == 1]
    assert sum(bad) <= 0.08 * len(bad) and sum(good) >= 0.99 * len(good) and len(bad) > 100


def insulting(rnd, wrong, n=600, insults=("wazzock", "numpty")):
    """Labelled texts, every other one with an insult; a share of the clean ones has one too."""
    out = []
    for i in range(n):
        words = prose(rnd, rnd.randint(20, 60)).split()
        if i % 2 or rnd.random() < wrong:
            words.insert(rnd.randrange(len(words)), rnd.choice(insults))
        out.append((i % 2, " ".join(words)))
    rnd.shuffle(out)
    return out


def test_insults_in_some_clean_documents_are_learned():
    rnd = random.Random(8)
    for wrong in (0.01, 0.04):
        model = K.train(insulting(rnd, wrong))
        score = lambda t: calibrate.probability(K.worst(model, t, {}), model.slope, model.intercept)
        right = [(score(t) >= 0.5) == bool(y) for y, t in insulting(rnd, 0.0, 200)]
        assert sum(right) >= 0.95 * len(right)


def test_insults_between_signs_and_in_long_words():
    assert "idiot" in K.units("an i - d - i - o - t".split())
    rnd = random.Random(9)
    model = K.train(insulting(rnd, 0.0))
    score = lambda t: calibrate.probability(K.worst(model, t, {}), model.slope, model.intercept)
    clean = prose(rnd, 40)
    assert score(clean) < 0.5
    for insult in ("w - a - z - z - o - c - k", "thehat" * 5 + "wazzock" + "inger" * 5):
        assert score(f"{clean} {insult} {clean}") >= 0.5, insult
    assert score("thehat" * 5 + "inger" * 5) < 0.5
