"""Evaluation texts that leak into training text (problem 7).

Spaced-seed hashing. A seed is a mask over neighbouring words that looks at some of them and ignores the rest. The
hashes of all seeds of the evaluation items are indexed; those of every document are joined to them, in batches of flat
word-id arrays. A document's word stands in a seed for each item word that it may be a misreading of: itself, or one with
a single letter changed, lost or added, found by the variants of both with a letter left out. Each hit names a document, an
item and the diagonal on which their words lie; on that diagonal words are compared one by one in the same sense, and
the longest run of words in a row decides.

As every word of a run takes part as itself or as its misreading, the seed of MASK at any place of a run is hit: every
run of RUN words is found, however many of its words are misread by a letter. Words with two misread letters end a run.

Scale: no shuffle before the found pairs. Items are stated queries against all rows; they go to the workers in blocks of
at most BLOCK_WORDS words, so a broadcast index is bounded whatever their number. A worker keeps the indexes of a pass,
PASS_BLOCKS blocks, and a pass reads the documents once. Seeds are expanded HITS at a time.

Defined results. Null, empty and blank texts hold nothing, items of fewer than `run` words are held by nothing. Case,
punctuation, composition of accents, look-alike letters, white space and hyphens before white space don't matter.
Very long texts are whole. Repeated items or documents give one row for each pair of ids. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.characters import consistent, slices
from docflow.session import pick, small_rows, spread

#: Words in a row that make a leak.
RUN = 15
#: Places of a seed's words; those between are ignored.
MASK = (0, 2, 4)
#: Words of the items in a block, whose index takes up to 1,000 bytes a word, and blocks of a pass.
BLOCK_WORDS, PASS_BLOCKS = 100_000, 4
BLOCK_ROWS = 100_000
#: Seeds held at once, and words whose near ones are remembered.
HITS, NEAR_WORDS = 1 << 21, 1 << 19
#: Texts of this many characters are taken apart at once.
SLICE_CHARS = 1_000_000

_HYPHEN = re.compile(r"(?<=[\w\u0300-\u036f])[-‐‑¬⸗]\s+(?=\w)")
#: Soft hyphens before white space, invisible signs aside; the consistent form would drop them.
_SOFT = re.compile(r"(?<![-‐‑¬⸗\xad])\xad(?=[\xad\u200b-\u200f\u2060-\u2064\ufeff]*\s)")
_INNER = re.compile(r"(?<=\w)[:'’](?=\w)")
_WORD = re.compile(r"[^\W_]+")


def words(texts: pa.Array) -> list[list[str]]:
    """The words of each text, in one form."""
    kept = pa.array([_SOFT.sub("-", t) if t and "\xad" in t else t for t in texts.to_pylist()], pa.string())
    return [_WORD.findall(_INNER.sub("", _HYPHEN.sub("", t).casefold())) if t else [] for t in consistent(kept).to_pylist()]


def one_letter_apart(a: str, b: str) -> bool:
    """Whether two words are equal, or equal but for one changed, lost or added letter."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _variants(word: str) -> set[str]:
    """The word, and the word with a letter left out: two words a letter apart share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def _expanded(counts: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of so many entries from begin on, the range's number and the place of each entry."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts - begin, counts)


class SeedIndex:
    """Seeds of items: sorted, with the item words that they begin at, and the pairs of words that begin a seed."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = words(pa.array([t for _, t in items], pa.string()))
        self.ids = np.array([i for i, _ in items], np.int64)
        self.vocabulary: dict[str, int] = {}
        flat = [self.vocabulary.setdefault(w, len(self.vocabulary)) for t in texts for w in t]
        self.words = list(self.vocabulary)
        self.variants: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            for v in _variants(w):
                self.variants.setdefault(v, []).append(i)
        self.known: dict[str, tuple[int, ...]] = {}
        self.flat = np.array(flat, np.int64)
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.item = np.repeat(np.arange(len(texts)), self.length)
        n = max(len(flat) - MASK[2], 0)
        at = np.flatnonzero(self.item[:n] == self.item[MASK[2] : MASK[2] + n])
        a, b, c = (self.flat[at + k] for k in MASK)
        # Three word ids in a number, which is exact below 2^21 words.
        seeds = (a << 42) | (b << 21) | c
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.at = seeds[order], at[order]
        self.pairs = np.unique(self.seeds >> 21)
        self.hashed = np.zeros(1 << 20, bool)
        self.hashed[_hash(self.pairs)] = True

    def near(self, word: str) -> tuple[int, ...]:
        """The item words that a word may be, ascending."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= NEAR_WORDS:
                self.known.clear()
            some = {i for v in _variants(word) for i in self.variants.get(v, ())}
            found = self.known[word] = tuple(sorted(i for i in some if one_letter_apart(word, self.words[i])))
        return found

    def found(self, texts: list[list[str]], run: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of the text, item) that share a run of words."""
        none = np.zeros(0, np.int64)
        local: dict[str, int] = {}
        doc = np.fromiter((local.setdefault(w, len(local)) for t in texts for w in t), np.int64, sum(map(len, texts)))
        if not len(doc) or not len(self.seeds):
            return none, none
        near = [self.near(w) for w in local]
        counts = np.array([len(x) for x in near], np.int64)
        begin = np.cumsum(counts) - counts
        near_ids = np.fromiter((i for x in near for i in x), np.int64, counts.sum())
        width = len(self.words) + 1
        keys = np.r_[np.repeat(np.arange(len(near)), counts) * width + near_ids, np.iinfo(np.int64).max]
        lengths = np.array([len(t) for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), lengths)
        end = len(doc)

        def same(d: np.ndarray, i: np.ndarray) -> np.ndarray:
            key = doc[d] * width + self.flat[i]
            return keys[np.searchsorted(keys, key)] == key

        def inside(d: np.ndarray, i: np.ndarray, text: np.ndarray, item: np.ndarray) -> np.ndarray:
            ok = (d >= 0) & (d < end) & (i >= 0) & (i < len(self.flat))
            d, i = np.where(ok, d, 0), np.where(ok, i, 0)
            ok &= (owner[d] == text) & (self.item[i] == item)
            ok[ok] = same(d[ok], i[ok])
            return ok

        n = max(end - MASK[2], 0)
        of = counts[doc]
        places = np.flatnonzero((owner[:n] == owner[MASK[2] : MASK[2] + n]) & np.logical_and.reduce([of[k : k + n] > 0 for k in MASK]))
        cost = np.cumsum(of[places] * of[places + MASK[1]])
        kept, low = [], 0
        while low < len(places):
            high = max(low + 1, int(np.searchsorted(cost, (cost[low - 1] if low else 0) + HITS, side="right")))
            d, i = self._hits(places[low:high], doc, of, begin, near_ids)
            low = high
            for ignored in sorted(set(range(MASK[2])) - set(MASK)):
                fits = same(d + ignored, i + ignored)
                d, i = d[fits], i[fits]
            size = np.full(len(d), MASK[2] + 1)
            for direction in (1, -1):
                at_d, at_i = (d + MASK[2], i + MASK[2]) if direction == 1 else (d, i)
                live = np.arange(len(d))
                for step in range(1, run):
                    live = live[size[live] < run]
                    live = live[inside(at_d[live] + direction * step, at_i[live] + direction * step, owner[d[live]], self.item[i[live]])]
                    if not len(live):
                        break
                    size[live] += 1
            long = size >= run
            kept.append(np.unique(np.stack([owner[d[long]], self.item[i[long]]]), axis=1))
        if not kept:
            return none, none
        pair = np.unique(np.concatenate(kept, axis=1), axis=1)
        return pair[0], self.ids[pair[1]]

    def _hits(self, places: np.ndarray, doc: np.ndarray, of: np.ndarray, begin: np.ndarray, near_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and item words at which a seed of these places begins: joined by the first two words, then by all three."""
        which, at = _expanded(of[places], begin[doc[places]])
        d, a = places[which], near_ids[at]
        second = doc[d + MASK[1]]
        which, at = _expanded(of[d + MASK[1]], begin[second])
        pair = (a[which] << 21) | near_ids[at]
        maybe = np.flatnonzero(self.hashed[_hash(pair)])
        pair, d = pair[maybe], d[which[maybe]]
        real = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        pair, d = pair[real], d[real]
        which, at = _expanded(of[d + MASK[2]], begin[doc[d + MASK[2]]])
        seed, d = (pair[which] << 21) | near_ids[at], d[which]
        left = np.searchsorted(self.seeds, seed)
        count = np.searchsorted(self.seeds, seed, side="right") - left
        which, at = _expanded(count, left)
        return d[which], self.at[at]


def _hash(pair: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


#: The indexes of the pass that a worker is in, by the block's own name.
_INDEXES: dict[str, SeedIndex] = {}


def _index(name: str, items) -> SeedIndex:
    if name not in _INDEXES:
        while len(_INDEXES) >= PASS_BLOCKS:
            _INDEXES.pop(next(iter(_INDEXES)))
        _INDEXES[name] = SeedIndex(items.value)
    return _INDEXES[name]


def _search(blocks: list[tuple[str, object]], key: str, run: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for low, high in slices(texts, SLICE_CHARS):
                read = words(texts.slice(low, high - low))
                for name, items in blocks:
                    at, item = _index(name, items).found(read, run)
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at + low)), pa.array(item)], names=[key, "item_id"])

    return search


def leaked(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, item_id of the documents that hold at least `run` words in a row of an item."""
    if run <= MASK[2]:
        raise ValueError(f"runs must be longer than {MASK[2]} words")
    spark, documents = documents.sparkSession, spread(pick(documents, "doc_id", "text"))
    sized = pick(items, "item_id", "text").where("text is not null")
    total = sized.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("words"), F.count("*").alias("rows")).first()
    blocks = max(1, math.ceil((total["words"] or 0) / BLOCK_WORDS), math.ceil(total["rows"] / BLOCK_ROWS * 2))
    kind = documents.schema["doc_id"].dataType.simpleString()
    found = None
    for first in range(0, blocks, PASS_BLOCKS):
        shared = []
        for block in range(first, min(first + PASS_BLOCKS, blocks)):
            rows = small_rows(sized.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block), BLOCK_ROWS, "items in a block")
            shared.append((uuid.uuid4().hex, spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])))
        part = documents.where("text is not null").mapInArrow(_search(shared, "doc_id", run), f"doc_id {kind}, item_id bigint")
        found = part if found is None else found.union(part)
    return found.distinct()


def report(found: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """Leaked items and affected documents by split of the items and source of the documents."""
    pairs = found.join(pick(items, "item_id", "split"), "item_id").join(pick(documents, "doc_id", "source"), "doc_id")
    return pairs.groupBy("split", "source").agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct("doc_id").alias("n_documents"))
