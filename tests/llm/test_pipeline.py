import hashlib

import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from marginalia.llm import compression_quality, covering_dedup, kernel_toxicity, pseudonyms
from marginalia.llm.common import written


@pytest.fixture(scope="module")
def steps(spark):
    """The documents after each stage, by the stage functions, over the smallest table."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf)))
    return sf, out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(steps):
    _, out = steps
    assert [name for name, _ in pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "private", "packing"]
    for df in out[1:-1]:
        assert df.dtypes == out[0].dtypes


def test_classifier_stages_drop_what_scores_say(spark, steps):
    sf, out = steps
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for module, before, after, keep in ((compression_quality, out[0], out[1], lambda s: s >= compression_quality.THRESHOLD),
                                        (kernel_toxicity, out[1], out[2], lambda s: s < kernel_toxicity.THRESHOLD)):
        model = module.fit(out[0], labels)
        scores = {r.doc_id: r.s for r in before.select("doc_id", module.scorer(model)("text").alias("s")).collect()}
        assert set(rows(after)) == {d for d, s in scores.items() if keep(s)}
        assert 0 < len(rows(after)) < before.count()


def test_dedup_keeps_one_of_each_group(steps):
    _, out = steps
    before, after = rows(out[2]), rows(out[3])

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {d: shingles(r.text) for d, r in before.items()}
    kept = [sets[d] for d in after]
    for d in before:
        if d not in after:  # what went has a copy, or a copy's copy, that stayed
            assert max(len(sets[d] & s) / len(sets[d] | s) for s in kept) > 0.5
    texts = [r.text for r in after.values()]
    assert len(set(texts)) == len(texts)
    ids = list(after)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            assert len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.8


def test_private_stage(spark, steps):
    _, out = steps
    before, after = rows(out[3]), rows(out[4])
    want = {r.doc_id: r.t for r in out[3].select("doc_id", pseudonyms.pseudonymised(out[3].text)["text"].alias("t")).collect()}
    assert {d: r.text for d, r in after.items()} == want and set(before) == set(after)
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_packing_stage(spark, steps):
    sf, out = steps
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    total = {d: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for d, r in rows(out[4]).items()}
    pieces = out[5].collect()
    seen = {}
    for p in pieces:
        seen[p.doc_id] = seen.get(p.doc_id, 0) + p.length
        assert p.doc_tokens == total[p.doc_id]
    assert seen == total
    digest = lambda ps: hashlib.md5(repr(sorted(map(tuple, ps))).encode()).hexdigest()
    assert digest(pipeline.run(spark, sf).collect()) == digest(pieces)


def test_stages_on_odd_documents(spark, steps):
    sf, out = steps
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = "of the and to in " * 40_000
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", len(long)), (3, long, "en", "s", len(long)),
                                 (None, "no id here", "en", "s", 10), (4, "4111111111111111", "en", "s", 16)], schema)
    for df in (odd, odd.limit(0), odd.withColumn("score", odd.doc_id * 2)):
        for name, stage in pipeline.STAGES:
            got = stage(spark, df, sf)
            if name != "packing":
                assert got.columns == df.columns
            got.collect()
    assert covering_dedup.keep_one(odd).count() == 4
