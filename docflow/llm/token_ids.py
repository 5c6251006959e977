"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

Prefix dynamic programming. For a byte string, each prefix has exactly one last token that the BPE encoding of the
prefix can end with; `PrefixTable` stores it, so a text's ids are read off backwards, an append only extends the
table, and an edit re-encodes near itself: from the first changed byte on until the last tokens are again the old ones
over as many bytes as any token has, as the rest follows from these alone. Whether a token may follow another is
settled by re-merging the two tokens' bytes, once per pair of tokens.

A corpus is encoded by pretokens: the vocabulary's published pattern cuts a text, each distinct pretoken is encoded
once a worker through its prefix table, and the memo is bounded. One narrow pass without a shuffle.

Defined results. Null and empty texts give an empty list; blank texts give the ids of their white space. Whole texts
of any length. A special token's string is ordinary text. Repeated rows count each. Empty tables give empty tables.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from docflow.session import pick, spread

#: Where the public vocabularies lie; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pretoken pattern of the vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pretokens that a worker remembers; beyond, the memo is cleared and built anew.
MEMO = 500_000
#: Pairs of tokens whose test a worker remembers; beyond, they are cleared too.
PAIRS = 1_000_000


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary, with the pair test that makes prefix tables exact."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        # Lengths of tokens by last two bytes: which last tokens a prefix can have at all.
        self._lengths: dict[bytes, list[int]] = {}
        for token in self.ranks:
            self._lengths.setdefault(token[-2:], []).append(len(token))
        self._lengths = {end: sorted(set(lengths), reverse=True) for end, lengths in self._lengths.items()}
        self._follows: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge(self, text: bytes) -> list[int]:
        """Ids by plain merging, lowest rank first; for the short strings of the pair test."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 60:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, before: int, after: int) -> bool:
        """Whether the two tokens stand side by side in an encoding."""
        known = self._follows.get((before, after))
        if known is None:
            if len(self._follows) >= PAIRS:
                self._follows.clear()
            known = self._follows[before, after] = self.merge(self.bytes[before] + self.bytes[after]) == [before, after]
        return known

    def lengths(self, text: bytes, end: int) -> list[int]:
        return [1, *self._lengths.get(text[max(end - 2, 0) : end], ())] if end == 1 else [*self._lengths.get(text[end - 2 : end], ()), 1]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, pretoken by pretoken."""
        memo = self.memo
        out = []
        for piece in _pattern().findall(text):
            ids = memo.get(piece)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                data = piece.encode("utf-8", "replace")
                whole = self.ranks.get(data)
                ids = memo[piece] = (whole,) if whole is not None else tuple(PrefixTable(self, data).ids())
            out.append(ids)
        return list(chain.from_iterable(out))


@cache
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


@cache
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The vocabulary at a path of this machine, else from the copy that encode() sent to the workers."""
    return Vocabulary(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


class PrefixTable:
    """The unique valid last token of each prefix of one pretoken's bytes."""

    def __init__(self, vocab: Vocabulary, data: bytes = b""):
        self.vocab, self.data, self.last = vocab, b"", []
        self.append(data)

    def append(self, data: bytes) -> PrefixTable:
        """Adds bytes at the end; the stored prefixes stay valid, so only the new ones are worked out."""
        self.data += data
        while len(self.last) < len(self.data):
            self._extend()
        return self

    def _extend(self) -> None:
        """The last token of the next prefix."""
        vocab, last, text = self.vocab, self.last, self.data
        end = len(last) + 1
        for n in vocab.lengths(text, end):
            if n > end:
                continue
            token = vocab.ranks.get(text[end - n : end])
            if token is not None and (n == end or vocab.follows(last[end - n - 1], token)):
                last.append(token)
                return
        raise ValueError("the vocabulary lacks a byte")

    def edit(self, at: int, removed: int, inserted: bytes = b"") -> PrefixTable:
        """Replaces bytes. Prefixes before the edit are kept; beyond it they are worked out until they are the old ones again."""
        old = self.last[at + removed :]
        self.data, self.last = self.data[:at] + inserted + self.data[at + removed :], self.last[:at]
        begin, same = at + len(inserted), 0
        while len(self.last) < len(self.data) and same < self.vocab.longest:
            self._extend()
            k = len(self.last) - begin
            same = same + 1 if k > 0 and self.last[-1] == old[k - 1] else 0
        self.last += old[len(self.last) - begin :]
        return self

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.vocab.bytes[token])
        return out[::-1]


def _encoder(key: str, text: str, path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            ids = [vocab.encode(t) if t else [] for t in batch.column(text).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    return encode


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """key, ids of each document as stored, without special tokens."""
    if os.path.exists(path):
        documents.sparkSession.sparkContext.addFile(path)
    kept = spread(pick(documents, key, text))
    return kept.mapInArrow(_encoder(key, text, path), f"{key} {kept.schema[key].dataType.simpleString()}, ids array<int>")
