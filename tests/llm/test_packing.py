import itertools
import struct
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from marginalia.llm import curve_packing as C

VOCABULARY = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("axes,depth", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(axes, depth):
    cells = np.array(list(itertools.product(range(1 << depth), repeat=axes)))
    key = C.hilbert_key(cells, depth)
    assert sorted(key) == list(range(len(cells)))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def whole(pieces, ids_of):
    """Pieces put together again: documents, and gapless sequences."""
    for doc, part in itertools.groupby(sorted(pieces, key=lambda p: (p.doc_id, p.start)), lambda p: p.doc_id):
        part, ids = list(part), ids_of[doc]
        at = 0
        for p in part:
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[at:at + p.length]))
            at += p.length
        assert at == len(ids)
    ends = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    full = sum(map(len, ids_of.values()))
    assert sorted(ends) == list(range(-(-full // C.SEQUENCE)))
    assert all(n == C.SEQUENCE for s, n in ends.items() if s != max(ends))


def test_query(spark, sf, library):
    ids = {r.doc_id: library(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces = C.op5(spark, sf).collect()
    assert {p.doc_id for p in pieces} == set(ids)
    whole(pieces, ids)


def test_odd_rows(spark, library):
    texts = [None, "", "a b <|endoftext|>  \n x", "word " * 9000, "é北🎉", "same", "same", " lead", "tail \n\n "]
    df = spark.createDataFrame([(i, t, 7, 7) for i, t in enumerate(texts)], "doc_id long, text string, ids int, row int")
    pieces = C.pack(df, VOCABULARY, public.PATTERN).collect()
    whole(pieces, {i: library(t) for i, t in enumerate(texts)})
    assert C.pack(df.limit(0), VOCABULARY, public.PATTERN).collect() == []
    twice = C.pack(df.unionAll(df).withColumn("doc_id", df.doc_id * 0), VOCABULARY, public.PATTERN).collect()
    assert sum(p.length for p in twice) == 2 * sum(len(library(t)) for t in texts)


def test_like_documents_are_neighbours(spark):
    """Two vocabularies, mixed by id, come apart along the curve."""
    one, two = "red green blue yellow orange", "horse cow pig sheep goat"
    df = spark.createDataFrame([(i, ((one if i % 2 else two) + " ") * (20 + i % 7)) for i in range(200)], "doc_id long, text string")
    order = [p.doc_id % 2 for p in sorted(C.pack(df, VOCABULARY, public.PATTERN).collect(), key=lambda p: (p.sequence_id, p.offset))]
    assert sum(a != b for a, b in zip(order, order[1:])) < 12
