"""Visually identical text in one consistent form (problem 2).

An Arrow batch of texts becomes one numpy array of code points with a row index. Lookup-table gathers drop invisible
signs, widen or replace single signs and expand ligatures by offsets; combining marks are composed pair by pair over
the whole array; look-alike letters are settled by the scripts present in each word. No text becomes a Python string
on the way, and the result goes back to Arrow through its buffers.

The consistent form: canonically composed accents; plain half-width letters (ligatures, Roman numeral signs and
mathematical letters as the letters they show), digits, marks and hyphens; ordinary spaces; no invisible signs; in a
word with Latin letters, Latin letters only, where one prints alike. Words wholly in another script and signs that print
differently (fractions, superscripts, numero signs, dashes, curly quotes) stay. A letter of another script or a phonetic
letter or small capital in a word with Latin letters is reported even where no Latin letter prints like it; it then stays.

Defined results. Null stays null and is consistent; empty text stays empty. Whole texts of any length are handled.
Repeated rows count each. A combining mark that composes with nothing stays. Line feeds, tabs and carriage returns
stay; the form is idempotent. Empty tables give empty tables; other columns are kept as they are.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from docflow.functions.names import LOOKALIKES
from docflow.session import pick

#: Characters of a batch that are taken apart at once; bounds the index arrays to some ten MB.
SLICE_CHARS = 500_000
#: Code points that the tables cover; all others stay as they are.
_SIZE = 0x20000
_LATIN, _FOREIGN, _LETTER, _MARK = 1, 2, 4, 8
#: Blocks of phonetic letters, and signs that show other letters: Latin ligatures, Roman numerals, mathematical letters and digits (fixed by Unicode).
_PHONETIC = ((0x0250, 0x02AF), (0x1D00, 0x1DBF), (0xAB30, 0xAB6F))
_SHOWN = ((0xFB00, 0xFB06), (0x2160, 0x217F), (0x1D400, 0x1D7FF))


@cache
def _tables() -> tuple[np.ndarray, Offsets, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Offsets]:
    """Built once a worker from unicodedata: one-to-one forms (-1 drops), expansions beyond the first sign, kinds, look-alikes, canonical pairs, combining classes, marks taken off composed letters."""
    one = np.arange(_SIZE, dtype=np.int64)
    more: dict[int, str] = {}
    kind = np.zeros(_SIZE, np.uint8)
    alike = np.arange(_SIZE, dtype=np.int64)
    ccc = np.zeros(_SIZE, np.uint8)
    pairs: dict[int, int] = {}
    for code in range(0x80, _SIZE):
        char = chr(code)
        category = unicodedata.category(char)
        if category in ("Cn", "Co", "Cs"):
            continue
        ccc[code] = unicodedata.combining(char)
        decomposition = unicodedata.decomposition(char)
        if category == "Cf" or code in (0x034F, 0x115F, 0x1160, 0x3164) or 0xFE00 <= code <= 0xFE0F:
            one[code] = -1
        elif category == "Zs":
            one[code] = 0x20
        elif decomposition.startswith(("<wide>", "<narrow>", "<noBreak>")) or any(low <= code <= high for low, high in _SHOWN):
            text = unicodedata.normalize("NFKC", char)
            one[code], more[code] = ord(text[0]), text
        elif decomposition and not decomposition.startswith("<"):
            text = unicodedata.normalize("NFC", char)
            if text != char:
                one[code], more[code] = ord(text[0]), text
            elif " " in decomposition:
                base, mark = (int(x, 16) for x in decomposition.split())
                pairs[base * _SIZE + mark] = code
    one[0x2010] = one[0x2011] = ord("-")
    more = {code: text for code, text in more.items() if len(text) > 1}
    for code in range(0x41, _SIZE):
        char = chr(code)
        category = unicodedata.category(char)
        if category[0] == "M":
            kind[code] = _MARK
        elif category[0] == "L" and category != "Lm":
            name = unicodedata.name(char, "")
            latin = name.startswith("LATIN")
            foreign = "SMALL CAPITAL" in name or any(low <= code <= high for low, high in _PHONETIC) or not latin and code >= 0x370 and not 0x2100 <= code < 0x2150
            kind[code] = _LETTER | (_FOREIGN if foreign else _LATIN if latin else 0)
    for source, target in LOOKALIKES.items():
        for a, b in zip(source, target, strict=True):
            alike[ord(a)] = ord(b)
    for code in np.flatnonzero(kind & _FOREIGN).tolist():  # accented look-alikes
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if not marks or ord(base) >= _SIZE:
            continue
        text = unicodedata.normalize("NFC", chr(alike[ord(base)]) + "".join(marks))
        if len(text) == 1:
            alike[code] = ord(text)
    keys = np.array(sorted(pairs), np.int64)
    made = [pairs[k] for k in keys.tolist()]
    return one, Offsets(more), kind, alike, keys, np.array(made, np.int64), ccc, Offsets({code: unicodedata.normalize("NFD", chr(code)) for code in made})


class Offsets:
    """Texts of code points as one array with an offset for each code: the first sign of each, and the signs beyond it."""

    def __init__(self, texts: dict[int, str]):
        self.first = np.arange(_SIZE, dtype=np.int64)
        counts = np.zeros(_SIZE + 1, np.int64)
        for code, text in texts.items():
            self.first[code], counts[code + 1] = ord(text[0]), len(text) - 1
        self.begin = np.cumsum(counts)
        self.signs = np.array([ord(c) for code in sorted(texts) for c in texts[code][1:]], np.int64)

    def inserted(self, points: np.ndarray, row: np.ndarray, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """points and rows with the further signs of codes put in after the places at."""
        n = self.begin[codes + 1] - self.begin[codes]
        where = np.repeat(at + 1, n)
        signs = self.signs[np.repeat(self.begin[codes], n) + np.arange(len(where)) - np.repeat(np.cumsum(n) - n, n)]
        return np.insert(points, where, signs), np.insert(row, where, np.repeat(row[at], n))


def slices(texts: pa.Array, chars: int = SLICE_CHARS) -> list[tuple[int, int]]:
    """Ranges of neighbouring texts with at most so many characters, or one text each that has more."""
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts, low = [], 0
    while low < len(texts):
        done = int(sizes[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, done + chars, side="right")))
        cuts.append((low, high))
        low = high
    return cuts


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string array and the number in each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return points, pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def to_strings(points: np.ndarray, row: np.ndarray, rows: int, valid: np.ndarray) -> pa.Array:
    """The string array of code points that belong to ascending rows."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    offsets = np.zeros(rows + 1, np.int64)
    np.cumsum(np.bincount(row, weights=width, minlength=rows).astype(np.int64), out=offsets[1:])
    out = pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pc.if_else(pa.array(valid), out, pa.scalar(None, pa.large_string())).cast(pa.string())


def _compose(points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composes base and mark where the two stand together, or only marks of a lower class stand between, until none is left."""
    _, _, _, _, keys, made, ccc, parts = _tables()
    small = np.minimum(points, _SIZE - 1)
    if len(points) and ccc[small].any():
        # A composed letter before a mark is taken apart, so that marks come into canonical order.
        apart = np.flatnonzero(np.isin(points, made) & np.r_[(ccc[small[1:]] > 0) & (row[1:] == row[:-1]), False])
        if len(apart):
            codes, points = points[apart], points.copy()
            points[apart] = parts.first[codes]
            points, row = parts.inserted(points, row, apart, codes)
            small = np.minimum(points, _SIZE - 1)
        # Marks of one run by class, stable.
        classes = ccc[small]
        run = np.cumsum((classes == 0) | np.r_[True, row[1:] != row[:-1]])
        order = np.lexsort((classes, run))
        points, row = points[order], row[order]
        while True:
            small = np.minimum(points, _SIZE - 1)
            marks = np.flatnonzero(ccc[small] > 0)
            if not len(marks):
                break
            starters = np.flatnonzero(ccc[small] == 0)
            before = np.searchsorted(starters, marks) - 1
            marks, before = marks[before >= 0], before[before >= 0]
            base = starters[before]
            # Blocked by a mark of the same class between.
            free = (base == marks - 1) | (ccc[small[marks - 1]] < ccc[small[marks]])
            pair = points[base] * _SIZE + points[marks]
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            hit = free & (keys[at] == pair) & (row[base] == row[marks]) & (points[base] < _SIZE)
            first = np.unique(base[hit], return_index=True)[1]
            where, at = np.flatnonzero(hit)[first], at[hit][first]
            if not len(where):
                break
            points = points.copy()
            points[base[where]] = made[at]
            keep = np.ones(len(points), bool)
            keep[marks[where]] = False
            points, row = points[keep], row[keep]
    return _compose_hangul(points, row)


def _compose_hangul(points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hangul letters composed by their rule: leading and vowel to a syllable, then a trailing letter to it."""
    if not ((points >= 0x1100) & (points < 0x1200)).any():
        return points, row
    for step in (0, 1):
        a, b = points[:-1], points[1:]
        if step == 0:
            hit = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
            made = 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28
        else:
            hit = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b >= 0x11A8) & (b < 0x11C3)
            made = a + b - 0x11A7
        hit &= row[:-1] == row[1:]
        points = np.r_[np.where(hit, made, a), points[-1:]]
        keep = ~np.r_[False, hit]
        points, row = points[keep], row[keep]
    return points, row


def _words(points: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Look-alikes inside words that also hold Latin letters become those; a word is a run of letters and marks."""
    _, _, kind, alike, *_ = _tables()
    small = np.minimum(points, _SIZE - 1)
    kinds = kind[small]
    if not (kinds & _FOREIGN).any():
        return points
    inside = (kinds & (_LETTER | _MARK)) > 0
    begins = inside & np.r_[True, ~inside[:-1] | (row[1:] != row[:-1])]
    word = np.cumsum(begins)
    latin = np.bincount(word[inside & ((kinds & _LATIN) > 0)], minlength=word[-1] + 1) > 0
    change = inside & ((kinds & _FOREIGN) > 0) & latin[word]
    return np.where(change, alike[small], points)


def consistent(texts: pa.Array) -> pa.Array:
    """The consistent form of each text of an Arrow array. Texts of plain signs only (_ODD) are settled by one regular expression."""
    odd = pc.fill_null(pc.match_substring_regex(texts, _ODD), False)
    if not pc.any(odd).as_py():
        return texts.cast(pa.string())
    return pc.replace_with_mask(texts.cast(pa.string()), odd, _consistent_slices(texts.filter(odd)))


#: Signs that may have another form, or stand beside such a mark: all but composed Latin ones.
_ODD = r"[^\x00-\x{9f}\x{a1}-\x{ac}\x{ae}-\x{24f}]"


def _consistent_slices(texts: pa.Array) -> pa.Array:
    parts = [_consistent(texts.slice(low, high - low)) for low, high in slices(texts)]
    return pa.concat_arrays([p.cast(pa.string()) for p in parts]) if parts else texts.cast(pa.string())


def _consistent(texts: pa.Array) -> pa.Array:
    one, more, *_ = _tables()
    valid = pc.is_valid(texts).to_numpy(zero_copy_only=False)
    points, lengths = code_points(texts)
    if not len(points) or int(points.max()) < 0x80:
        return texts
    row = np.repeat(np.arange(len(texts)), lengths)
    small = np.minimum(points, _SIZE - 1)
    at = np.flatnonzero((more.begin[small + 1] > more.begin[small]) & (points < _SIZE))
    points = np.where(points < _SIZE, one[small], points)
    if len(at):
        points, row = more.inserted(points, row, at, small[at])
    keep = points >= 0
    points, row = points[keep], row[keep]
    points, row = _compose(points, row)
    settled = _words(points, row)
    if settled is not points:
        settled, row = _compose(settled, row)  # a mark may compose with the plain letter only
    return to_strings(settled, row, len(texts), valid)


def strangers(texts: pa.Array) -> np.ndarray:
    """Whether a word of the text holds Latin letters and letters of another script or phonetic ones, also such as print like no Latin letter."""
    _, _, kind, *_ = _tables()
    points, lengths = code_points(texts)
    row = np.repeat(np.arange(len(texts)), lengths)
    kinds = kind[np.minimum(points, _SIZE - 1)]
    out = np.zeros(len(texts), bool)
    if (kinds & _FOREIGN).any():
        inside = (kinds & (_LETTER | _MARK)) > 0
        word = np.cumsum(inside & np.r_[True, ~inside[:-1] | (row[1:] != row[:-1])])
        has = [np.bincount(word[inside & ((kinds & k) > 0)], minlength=word[-1] + 1) > 0 for k in (_LATIN, _FOREIGN)]
        out[row[inside & (has[0] & has[1])[word]]] = True
    return out


@F.arrow_udf(StringType())
def consistent_text(texts: pa.Array) -> pa.Array:
    """consistent() as a column function."""
    return consistent(texts)


@F.arrow_udf(BooleanType())
def is_inconsistent(texts: pa.Array) -> pa.Array:
    """Whether a text isn't in the consistent form."""
    form = consistent(texts)
    mixed = np.concatenate([np.zeros(0, bool), *(strangers(form.slice(low, high - low)) for low, high in slices(form))])
    return pa.array(pc.fill_null(pc.not_equal(form, texts), False).to_numpy(zero_copy_only=False) | mixed)


def unify(lines: DataFrame, column: str = "transcription") -> DataFrame:
    """lines with the column in the consistent form."""
    names, at = lines.columns, lines.columns.index(column)
    plain = lines.toDF(*(f"_{i}" for i in range(len(names))))
    return plain.withColumn(f"_{at}", consistent_text(F.col(f"_{at}"))).toDF(*names)


def inconsistent(lines: DataFrame, key: str = "line_pk", column: str = "transcription") -> DataFrame:
    """Keys of the rows whose text isn't in the consistent form. Plain ASCII texts are settled in the JVM before the Arrow pass."""
    beyond: Column = F.col(column).rlike(r"[^\x00-\x7f]")
    return pick(lines, key, column).where(beyond).where(is_inconsistent(F.col(column))).select(key)
