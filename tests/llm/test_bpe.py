import hashlib
import random
import struct

import public_tokenizers as public
import pytest
import tiktoken

from marginalia.llm import bpe

PATH = public.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_single_pieces_equal_the_merges(name):
    ranks = bpe.read_ranks(public.path(name))
    lib = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, rnd, tokens = bpe.Backtracker(ranks, memo=500), random.Random(7), [t for t in ranks if len(t) > 1]
    for i in range(4000):
        piece = [lambda: bytes(rnd.choice(b"abcdefghij e") for _ in range(rnd.randint(1, 30))),
                 lambda: b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 5))),
                 lambda: bytes(rnd.randrange(256) for _ in range(rnd.randint(1, 12))),
                 lambda: rnd.choice([b"a", b"ab", b" ", b"!!", b"aa"]) * rnd.randint(1, 90)][i % 4]()
        assert coder._encode(piece.decode("latin-1")) == tuple(lib._core_bpe.encode_single_piece(piece)), piece


def test_texts_of_every_kind_of_white_space(library):
    encode, rnd = bpe.text_encoder(bpe.Backtracker(bpe.read_ranks(PATH), memo=60), public.PATTERN), random.Random(9)
    bits = [" ", " ", " ", "a", "the", "It's", "9", ",", "!!", "\n", "\n\n", "\t", "\u00a0", "\u2003", "é", "北", "🎉", "\x1c", "\x85", "'s", "_", "\u200b", "\x00"]
    for _ in range(6000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        ids = library.encode_ordinary(text)
        assert encode(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)


def test_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        bpe.Backtracker({b"a": 0})


def test_documents(spark, library):
    texts = [None, "", " ", "It's 10 o'clock\n\n  naïve 北京 🎉 <|endoftext|>", "a" * 200_000, " \t" * 5000, "x y " * 3, "x y " * 3]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded int")
    got = {r.doc_id: r for r in bpe.encode_documents(df, PATH, public.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert bytes(got[i].ids) == struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(got[i].decoded) == (t or "").encode()
    assert bpe.encode_documents(df.limit(0), PATH, public.PATTERN).collect() == []


def test_query(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.op10(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
