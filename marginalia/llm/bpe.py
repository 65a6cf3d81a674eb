"""Byte-level BPE by longest match and backtracking, with the merges' exact result in linear time.

A sequence of tokens is what the merges give exactly when each adjacent pair is: the merges of the
two tokens' joined bytes would give back those two tokens. An automaton names the longest token at a
place; when it does not fit its left neighbour, the next shorter prefix token is tried, and when none
is left the last token is taken back. A bit per position marks places known to lead nowhere, so no
position is tried twice.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import query, small_batches, table

#: Distinct pre-tokens and token pairs a task remembers; results do not depend on it.
MEMO = 600_000


def read_ranks(path: str) -> dict[bytes, int]:
    """``token bytes -> rank`` of a rank file (base64 and number per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Memo(dict):
    """A bounded memo: once full it takes nothing new, and starts afresh after as many misses again."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.missed = most, 0

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.missed += 1
            if self.missed < self.most:
                return
            self.clear()
            self.missed = 0
        self[key] = value


def of_worker(key: tuple, make):
    """``make()`` once in the life of a Python worker, which serves many tasks."""
    import sys
    import types

    held = sys.modules.setdefault("marginalia_of_worker", types.ModuleType("marginalia_of_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


class Backtracker:
    """Encoder of single pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], memo: int = MEMO):
        import ahocorasick

        self.ranks, self.memo = ranks, memo
        self.size = max(ranks.values(), default=-1) + 1
        self.bytes = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes, {missing[0]} first")
        self.trie = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.trie.add_word(token.decode("latin-1"), rank)
        self.trie.make_automaton()
        self.sizes = [len(t) for t in self.bytes]
        self.shorter = [self._prefix(t) for t in self.bytes]
        parts = [self._split(t) if t else None for t in self.bytes]  # token -> the pair its merge joins
        self.head = [p[0] if p else -1 for p in parts]
        self.tail = [p[1] if p else -1 for p in parts]
        self.joined = {p[0] * self.size + p[1]: t for t, p in enumerate(parts) if p}
        self.fits: dict[int, bool] = {}
        self.known = Memo(memo)

    def _prefix(self, whole: bytes) -> int:
        """The longest token that is a proper prefix, -1 if none."""
        return next((self.ranks[whole[:n]] for n in range(len(whole) - 1, 0, -1) if whole[:n] in self.ranks), -1)

    def _split(self, whole: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``whole`` when its bytes are merged by rank; None for single bytes."""
        ranks, limit = self.ranks, self.ranks[whole]
        pieces = [whole[i:i + 1] for i in range(len(whole))]
        while len(pieces) > 2:
            found = [ranks.get(a + b, limit) for a, b in zip(pieces, pieces[1:])]
            best = min(found)
            if best >= limit:
                return None  # no merge makes this token
            i = found.index(best)
            pieces[i:i + 2] = [pieces[i] + pieces[i + 1]]
        return (ranks[pieces[0]], ranks[pieces[1]]) if len(pieces) == 2 else None

    def fit(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both, by rank and from the left, ends in just these two."""
        key = left * self.size + right
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) >= self.memo:
                self.fits.clear()
            got = self.fits[key] = self._fit(left, right)
        return got

    def _fit(self, left: int, right: int) -> bool:
        # take the later merge of the two sides apart, again and again: a merge across the seam that ranks
        # before it would have come first
        joined, size, head, tail = self.joined.get, self.size, self.head, self.tail
        limit = size
        while True:
            if joined(left * size + right, limit) < limit:
                return False
            if left > right:
                if tail[left] >= 0:
                    limit, left = left, tail[left]
                elif head[right] >= 0:
                    limit, right = right + 1, head[right]
                else:
                    return True
            elif head[right] >= 0:
                limit, right = right + 1, head[right]
            elif tail[left] >= 0:
                limit, left = left, tail[left]
            else:
                return True

    def encode(self, match: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        got = self.known.get(match)
        if got is None:
            got = self.fresh(match)
            if len(match) <= 64:
                self.known.keep(match, got)
        return got

    def fresh(self, match: str) -> tuple[int, ...]:
        """Like :meth:`encode`, not remembered."""
        return self._encode(match.encode("utf-8").decode("latin-1"))  # a character per byte, for the automaton

    def _encode(self, word: str) -> tuple[int, ...]:
        whole = word.encode("latin-1")
        rank = self.ranks.get(whole)
        if rank is not None:
            return (rank,)
        fits, fit, size, sizes, shorter = self.fits.get, self.fit, self.size, self.sizes, self.shorter
        out, n = [token for _, token in self.trie.iter_long(word)], len(whole)
        if sum([sizes[t] for t in out]) == n:  # no byte is skipped: longest matches that fit are the answer
            last = out[0]
            for token in out[1:]:
                if not (fits(last * size + token) or fit(last, token)):
                    break
                last = token
            else:
                return tuple(out)
        longest, dead, out, last = self._longest(word), bytearray(n + 1), [], -1
        at, token = 0, longest[0]
        while at < n:
            end = at + sizes[token]
            if not dead[end] and (last < 0 or fits(last * size + token) or fit(last, token)):
                out.append(token)
                last, at = token, end
                if at < n:
                    token = longest[at]
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here: take the last token back and shorten it
                dead[at] = 1
                if not out:
                    raise ValueError("the merges cannot spell this text")
                at -= sizes[last]
                token = shorter[last]
                out.pop()
                last = out[-1] if out else -1
        return tuple(out)

    def _longest(self, word: str) -> list[int]:
        """The longest token starting at each place."""
        out, sizes = [-1] * len(word), self.sizes
        for end, rank in self.trie.iter(word):  # ends rise, so a longer match comes later
            out[end - sizes[rank] + 1] = rank
        return out


def text_encoder(coder: Backtracker, pattern: str):
    """``text -> ids`` as little-endian unsigned 32-bit bytes; each match of ``pattern`` on its own.

    No match goes on over a blank after a non-blank, so a text may be cut before such blanks, and the
    pieces remembered. Pieces with other white space in or around them are matched together. This
    holds for patterns whose only optional first character is the blank, as in the public one. Where
    letters are one match of the pattern, a piece of letters, or of letters and a sign, needs no matching.
    """
    import struct

    import regex

    find, known, pieces = regex.compile(pattern).findall, coder.encode, Memo(coder.memo)

    letters, fresh, pack = r" ?\p{L}+" in pattern, coder.fresh, struct.pack

    def coded(part: str) -> bytes:
        ids = [i for match in find(part) for i in known(match)]
        return pack(f"<{len(ids)}I", *ids)

    def word(piece: str) -> bytes:
        """A piece of letters, with the blank before it."""
        got = pieces.get(piece)
        if got is None:
            ids = fresh(" " + piece)
            got = pack(f"<{len(ids)}I", *ids)
            if len(piece) <= 64:
                pieces.keep(piece, got)
        return got

    def encode(text: str) -> bytes:
        first, *rest = text.split(" ")
        parts, done = list(map(pieces.get, rest)), 0

        def together(start: int, lead: str) -> tuple[bytes, int]:
            """Pieces from ``start`` on up to one that ends in no white space, coded as one."""
            end = start
            while end < len(rest) and (not rest[end] or rest[end][-1].isspace()):
                end += 1
            return coded(" ".join([lead, *rest[start:end + 1]])), end + 1

        if first and not first[-1].isspace():
            head = coded(first)
        else:
            head, done = together(0, first)
            parts[:done] = [b""] * min(done, len(rest))
        if None in parts:
            for i, ids in enumerate(parts):
                if ids is not None or i < done:
                    continue
                piece = rest[i]
                if letters and piece.isalpha():
                    parts[i] = word(piece)
                elif letters and piece[:-1].isalpha() and piece[-1] in ".,":
                    parts[i] = ids = word(piece[:-1]) + coded(piece[-1])
                    if len(piece) <= 64:
                        pieces.keep(piece, ids)
                elif piece and not piece[-1].isspace():
                    parts[i] = ids = coded(" " + piece)
                    if len(piece) <= 64 and len(piece.split(None, 1)) == 1 and not piece[0].isspace():
                        pieces.keep(piece, ids)
                else:
                    ids, done = together(i, "")
                    parts[i:done] = [ids] + [b""] * (min(done, len(rest)) - i - 1)
        return head + b"".join(parts)

    return encode


def codec(vocabulary: str, pattern: str, memo: int = MEMO):
    """Column functions ``(encode, decode)``: text to ids as little-endian unsigned 32-bit binary, and back to bytes.

    Ids equal those of the merges applied to each match of ``pattern`` (taken by the ``regex``
    module) separately, no special tokens. Null and empty texts give no ids. Each task reads the rank
    file from ``vocabulary``, a path every executor has, and builds the automaton once.
    """
    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = of_worker((vocabulary, pattern, memo), lambda: text_encoder(Backtracker(read_ranks(vocabulary), memo), pattern))
        for texts in batches:
            yield pd.Series([one(t or "") for t in texts], dtype=object)

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        pieces: dict[int, bytes] = {rank: token for token, rank in read_ranks(vocabulary).items()}
        for ids in batches:
            yield pd.Series([b"".join(map(pieces.__getitem__, np.frombuffer(x or b"", dtype="<u4").tolist())) for x in ids],
                            dtype=object)

    return encode, decode


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, ids, decoded)`` for every row: ids as binary, and the bytes they decode to."""
    small_batches(docs.sparkSession)
    encode, decode = codec(vocabulary, pattern)
    coded = docs.select(F.col(doc_id).alias("doc_id"), encode(F.col(text)).alias("ids"))
    return coded.select("doc_id", "ids", decode(F.col("ids")).alias("decoded"))


@query("op10_backtracking_bpe")
def op10(spark, sf_dir):
    import public_tokenizers as public

    coded = encode_documents(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
