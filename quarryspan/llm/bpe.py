"""Encoding of texts with a public byte-pair vocabulary, by a trie of their distinct words.

A text is split into words by the vocabulary's pattern. The distinct words of a batch that aren't known yet form a
trie, which is walked depth first: the state of a prefix is the last token of its encoding, and the
encoding before that token is the encoding of a shorter prefix, whose state is known. So a prefix
shared by many words is encoded once. Sorted words with a stack of states are that walk.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the public vocabulary files lie, on all machines.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits a text into words for this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a worker keeps at most; it starts anew beyond that, which changes no result.
KEPT_WORDS = 1_000_000


class PrefixEncoder:
    """Byte-pair encoding of words by last tokens of prefixes."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        #: Every ending of a token: going back from a place ends where no token can begin further left.
        self.endings = {t[k:] for t in self.ranks for k in range(len(t))}
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN).findall

    def merged(self, word: bytes) -> list[int]:
        """Plain merging: again and again the adjacent pair of lowest rank."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fit(self, left: int, right: int) -> bool:
        """Whether the two tokens stand side by side in the encoding of their bytes."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def learn(self, words: list[str]) -> None:
        """Encode new distinct words in one walk over their trie."""
        ranks, endings, fit = self.ranks, self.endings, self._fit
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        before = b""
        last: list[int] = [-1]  # last[i]: the last token of the first i bytes
        size: list[int] = [0]
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared = 0
            for a, b in zip(before, raw):
                if a != b:
                    break
                shared += 1
            del last[shared + 1:], size[shared + 1:]
            for i in range(shared + 1, len(raw) + 1):
                found = []
                for k in range(i - 1, -1, -1):
                    piece = raw[k:i]
                    if piece not in endings:
                        break
                    token = ranks.get(piece)
                    if token is not None:
                        found.append((k, token))
                for k, token in reversed(found):  # the longest first; exactly one fits
                    if k == 0 or fit(last[k], token):
                        last.append(token)
                        size.append(i - k)
                        break
                else:  # a vocabulary lacks a byte, or its merges don't build its tokens
                    raise ValueError(f"no token of the vocabulary ends at byte {i} of {raw!r}")
            ids = []
            i = len(raw)
            while i:
                ids.append(last[i])
                i -= size[i]
            self.words[word] = tuple(reversed(ids))
            before = raw

    def encode_batch(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, all of them known afterwards."""
        split = self.split
        parts = [split(t) if t else [] for t in texts]
        known = self.words
        new = {w for p in parts for w in p if w not in known}
        if new:
            if len(known) > KEPT_WORDS:
                known.clear()
                new = {w for p in parts for w in p}
            self.learn(list(new))
        return parts


_encoders: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """The encoder of this process for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(path)
    return _encoders[path]


def encode(documents: DataFrame, vocabulary: str = "byte_bpe_50k", key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """Rows (doc_id, ids): the token ids of every text, without special tokens and without a shuffle.

    Null and empty texts have no ids (an empty list). Texts are encoded whole; repeated rows give repeated rows.
    """
    path = f"{folder}/{vocabulary}.tiktoken"

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in rows:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                words = known.encode_batch(part.column(1).to_pylist())
                of = known.words
                ids = [list(chain.from_iterable(map(of.__getitem__, w))) for w in words]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    return documents.selectExpr(f"cast(`{key}` as long) AS doc_id", f"`{text}` AS text").mapInArrow(batches, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str = "byte_bpe_50k", key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """Rows (doc_id, tokens): the number of tokens of every text; 0 for null and empty texts."""
    path = f"{folder}/{vocabulary}.tiktoken"

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in rows:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                words = known.encode_batch(part.column(1).to_pylist())
                of = known.words
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sum(map(len, map(of.__getitem__, w))) for w in words], pa.int64())], ["doc_id", "tokens"])

    return documents.selectExpr(f"cast(`{key}` as long) AS doc_id", f"`{text}` AS text").mapInArrow(batches, "doc_id long, tokens long")
