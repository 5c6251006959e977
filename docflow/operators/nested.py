"""Nested page records flattened to regions, lines and polygon points through their buffers (problem 5).

A batch of payloads is handled as one byte buffer. Array passes find the quotes, then the structural signs outside
strings, their depth, each sign's container and each value's position, the same arrays that Arrow keeps as list
offsets and parent indices. The same arrays settle which payloads are JSON: brackets match, tokens follow one another
as the grammar allows, escapes and scalars are well-formed. Regions, lines and points are then gathered level by level
with vectorised takes that carry the keys along, and strings are unescaped in one buffer. No payload, record or string
is parsed by itself.

Scale: one pass over the payloads. Which pages are stored more than once is settled by an aggregate of ids and digests,
and only those pages move: the list of them is a written table, whose size tells Spark whether it may be broadcast.

Defined results. Null payloads and payloads that aren't JSON (by RFC 8259, so NaN isn't) give nothing. Missing, null and
empty fields and fields of other kinds give no children. Of a key that an object repeats the last value counts; keys may
be written with escapes. An object where an array should be has position 0; a null entry keeps its position but gives no
row, as does an entry that is no object (for points: an empty string). `Page` may be wrapped in an object, be an array
(its first object counts) or be absent, when the root itself is the page. Values nest to any depth. Of a page_id stored
more than once the latest loaded copy counts, of equally late ones the one with the greatest MD5. Halves of surrogate
pairs become U+FFFD. Long texts are whole. An empty table gives empty tables. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.session import materialise, pick, spread

#: Bytes of payload that are taken apart at once; bounds the index arrays to some hundred MB.
SLICE_BYTES = 4 << 20

KEYS = ("Page", "regions", "lines", "polygon", "points", "x", "y", "region_id", "line_id", "transcription")
_COLON, _COMMA, _QUOTE, _BACKSLASH = ord(":"), ord(","), ord('"'), ord("\\")


#: What a string, a number or a literal may look like to be JSON (fixed by RFC 8259).
_SCALAR = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null)$"
#: Rows and bytes of a batch of results, about.
OUT_ROWS, OUT_BYTES = 1 << 16, 16 << 20


def _one_of(signs: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(signs, np.uint8)] = True
    return table


_SIGN, _BLANK, _HEX, _ESCAPED, _DIGIT, _NONZERO = _one_of(b"{}[]:,"), _one_of(b" \t\r\n"), _one_of(b"0123456789abcdefABCDEF"), _one_of(b'"\\/bfnrtu'), _one_of(b"0123456789"), _one_of(b"123456789")
_IS_OPEN, _IS_CLOSE = _one_of(b"{["), _one_of(b"}]")
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[np.frombuffer(b"bfnrt", np.uint8)] = np.frombuffer(b"\b\f\n\r\t", np.uint8)
_VALUE_OF_HEX = np.zeros(256, np.int64)
_VALUE_OF_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = _VALUE_OF_HEX[np.frombuffer(b"0123456789ABCDEF", np.uint8)] = np.arange(16)


def _escapes(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places of the backslashes that begin an escape, which are every other one of a run; runs end where a text begins."""
    slashes = np.flatnonzero(data == _BACKSLASH)
    if not len(slashes):
        return slashes
    text = np.searchsorted(begins, slashes, side="right")
    new = np.r_[True, (np.diff(slashes) > 1) | (np.diff(text) > 0)]
    first = slashes[new][np.cumsum(new) - 1]
    return slashes[(slashes - first) & 1 == 0]


def _unescaped(texts: pa.Array) -> pa.Array:
    """JSON strings without their quotes as plain ones, all at once: escapes are overwritten in the buffer and shortened."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    at = _escapes(data, offsets)
    if len(at):
        data, kept = np.r_[data, np.zeros(6, np.uint8)], np.ones(len(data), bool)
        letter = data[at + 1]
        plain = at[letter != ord("u")]
        kept[plain] = False
        data[plain + 1] = _PLAIN[data[plain + 1]]
        at = at[letter == ord("u")]
        code = sum(_VALUE_OF_HEX[data[at + 2 + k]] << (12 - 4 * k) for k in range(4))
        high, low = (code >= 0xD800) & (code < 0xDC00), (code >= 0xDC00) & (code < 0xE000)
        pair = np.r_[high[:-1] & low[1:] & (np.diff(at) == 6), False] if len(at) else high
        second = np.r_[False, pair[:-1]] if len(at) else low
        following = np.r_[code[1:], 0] if len(at) else code
        code = np.where(pair, 0x10000 + ((code - 0xD800) << 10) + following - 0xDC00, np.where(high | low, 0xFFFD, code))
        size = np.where(second, 0, 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000))
        for k in range(6):
            kept[at + k] = k < size
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
        for k in range(4):
            here = size > k
            tail = code >> (6 * np.maximum(size - 1 - k, 0))
            data[at[here] + k] = (tail | lead if k == 0 else 0x80 | tail & 0x3F)[here]
        sums = np.r_[0, np.cumsum(kept)]
        data, offsets = data[:-6][kept], sums[offsets]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())]).cast(pa.string())


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[start:end] for each pair, as a binary array."""
    lengths = np.maximum(end - start, 0)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    take = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], lengths)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[take])]).cast(pa.binary())


class Values:
    """The values of all JSON texts of a buffer: where each begins and ends, the container it is in and its key or position there.

    `open` holds each container's byte; a value that is a container names it in `child`. Roots have container -1 - row.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        begins = offsets[:-1]
        row_of = lambda at: np.searchsorted(begins, at, side="right") - 1
        escapes = _escapes(data, begins)
        quotes = np.flatnonzero(data == _QUOTE)
        if len(escapes):
            after = np.zeros(len(data) + 1, bool)
            after[escapes + 1] = True
            quotes = quotes[~after[quotes] | np.isin(quotes, begins)]
        before = np.searchsorted(quotes, begins)  # quotes of the texts before each
        signs = np.flatnonzero(_SIGN[data])
        row = row_of(signs)
        outside = (np.searchsorted(quotes, signs) - before[row]) & 1 == 0
        signs, row = signs[outside], row[outside]
        self.good = self._are_json(offsets, quotes, before, signs, row, escapes)
        signs, quotes = signs[self.good[row]], quotes[self.good[row_of(quotes)]]
        kind, opens, closes, level, own = _containers(data, signs)
        self.closing = quotes  # each string's opening quote is followed by its closing one
        self.open = signs[opens]
        self.close = np.empty(len(self.open), np.int64)
        self.close[own[closes]] = signs[closes]
        # A value follows a colon, a comma of an array, an array's opening sign, or begins a text.
        in_array = data[self.open] == ord("[")
        starts = (kind == _COLON) | ((kind == _COMMA) | opens) & in_array[np.where(own < 0, 0, own)] if len(self.open) else np.zeros(0, bool)
        at = np.flatnonzero(starts)
        solid = np.flatnonzero(~_BLANK[data])
        row_of_root = np.flatnonzero(self.good)
        roots = begins[row_of_root]
        begin = np.concatenate([solid[np.minimum(np.searchsorted(solid, signs[at] + 1), max(len(solid) - 1, 0))], solid[np.searchsorted(solid, roots)]]) if len(solid) else np.zeros(0, np.int64)
        container = np.concatenate([own[at], -1 - row_of_root])
        sign = np.concatenate([at, np.full(len(roots), -1)])
        empty = (sign >= 0) & (data[begin] == ord("]"))
        empty &= np.concatenate([opens[at], np.zeros(len(roots), bool)])
        begin, container, sign = begin[~empty], container[~empty], sign[~empty]
        self.begin, self.container, self.first = begin, container, data[begin]
        is_open = _IS_OPEN[self.first]
        self.child = np.where(is_open, np.searchsorted(self.open, begin), -1)
        # A scalar ends before the next sign, or with its text.
        following = np.searchsorted(signs, begin)
        stop = np.minimum(np.r_[signs, len(data)][following], offsets[1:][row_of(begin)])
        self.end = np.where(is_open, self.close[np.maximum(self.child, 0)] + 1 if len(self.close) else stop, stop)
        # Position in an array: the commas of its container before it.
        commas = np.flatnonzero(kind == _COMMA)
        width = len(data) + 1
        keyed = np.sort(own[commas] * width + signs[commas])
        self.position = np.searchsorted(keyed, container * width + begin) - np.searchsorted(keyed, container * width)
        # Key in an object: the string that ends before the colon.
        self.key = np.full(len(begin), -1)
        self.key_begin = np.zeros(len(begin), np.int64)
        self.key_end = np.zeros(len(begin), np.int64)
        named = np.flatnonzero((sign >= 0) & (kind[np.maximum(sign, 0)] == _COLON)) if len(kind) else np.zeros(0, np.int64)
        last = np.searchsorted(quotes, signs[sign[named]]) - 1
        self.key_begin[named], self.key_end[named] = quotes[last - 1] + 1, quotes[last]
        length = self.key_end[named] - self.key_begin[named]
        for k, name in enumerate(KEYS):
            text = np.frombuffer(name.encode(), np.uint8)
            fits = named[length == len(text)]
            same = (data[self.key_begin[fits][:, None] + np.arange(len(text))] == text).all(axis=1)
            self.key[fits[same]] = k
        if len(escapes):  # keys with escapes
            some = named[np.searchsorted(escapes, self.key_end[named]) > np.searchsorted(escapes, self.key_begin[named])]
            at = pc.index_in(_unescaped(_slices(data, self.key_begin[some], self.key_end[some])), pa.array(KEYS))
            self.key[some] = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)
        order = np.argsort(container, kind="stable")
        self._order, self._sorted = order, container[order]

    def _are_json(self, offsets: np.ndarray, quotes: np.ndarray, before: np.ndarray, signs: np.ndarray, row: np.ndarray, escapes: np.ndarray) -> np.ndarray:
        """Which texts are JSON. A text in error can't mislead another: quotes, brackets and tokens are counted within each."""
        data, begins, rows = self.data, offsets[:-1], len(offsets) - 1
        bad = np.zeros(rows, bool)
        row_of = lambda at: np.searchsorted(begins, at, side="right") - 1
        inside = lambda at, of: (np.searchsorted(quotes, at) - before[of]) & 1 == 1
        n_quotes = np.diff(np.r_[before, len(quotes)])
        bad |= (n_quotes & 1 == 1) | (offsets[:-1] == offsets[1:])
        # Control signs inside strings, backslashes outside, escapes of other letters or cut off by the text's end.
        control = np.flatnonzero(data < 0x20)
        of = row_of(control)
        bad[of[inside(control, of)]] = True
        if len(escapes):
            of = row_of(escapes)
            padded = np.r_[data, np.zeros(6, np.uint8)]
            letter, room = padded[escapes + 1], offsets[1:][of] - escapes
            fits = inside(escapes, of) & _ESCAPED[letter] & (room > 1)
            code = letter == ord("u")
            fits &= ~code | (room > 5) & np.logical_and.reduce([_HEX[padded[escapes + k]] for k in range(2, 6)])
            bad[of[~fits]] = True
        # Scalars: runs outside strings of anything but signs, quotes and blanks.
        loose = ~(_SIGN[data] | _BLANK[data])
        loose[quotes] = False
        toggle = np.zeros(len(data) + 1, np.int8)
        toggle[quotes] = 1
        quoted = np.cumsum(toggle[:-1], dtype=np.int64)
        quoted -= np.repeat(before, np.diff(offsets))
        loose &= quoted & 1 == 0
        at = np.flatnonzero(loose)
        of = row_of(at)
        new = np.r_[True, (np.diff(at) > 1) | (np.diff(of) > 0)] if len(at) else np.zeros(0, bool)
        start, end = at[new], np.r_[at[1:][new[1:]] if len(at) else at, 0]
        end = at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]] + 1 if len(at) else at
        digits = np.r_[0, np.cumsum(_DIGIT[data])]
        plain = (digits[end] - digits[start] == end - start) & (_NONZERO[data[start]] | (end - start == 1))
        odd_ones = np.flatnonzero(~plain)
        if len(odd_ones):
            texts = _slices(data, start[odd_ones], end[odd_ones])
            ascii_only = np.logical_not(pc.match_substring_regex(texts.cast(pa.large_binary()), r"[^ -~]").to_numpy(zero_copy_only=False))
            fits = np.zeros(len(odd_ones), bool)
            fits[ascii_only] = pc.match_substring_regex(texts.filter(pa.array(ascii_only)).cast(pa.string()), _SCALAR).to_numpy(zero_copy_only=False)
            bad[row_of(start[odd_ones[~fits]])] = True
        # Brackets match within their text.
        kind, opens, closes, level, own = _containers(data, signs)
        step = opens.astype(np.int64) - closes
        depth = np.r_[0, np.cumsum(step)]
        first, last = np.searchsorted(row, np.arange(rows)), np.searchsorted(row, np.arange(rows), side="right")
        bad |= depth[first] != depth[last]
        bad[row[depth[1:] < depth[first][row]]] = True
        shut = np.flatnonzero(closes)
        partner = own[shut]
        opener = signs[opens]
        fits = partner >= 0
        fits[fits] &= (data[opener[partner[fits]]] == ord("{")) == (kind[shut[fits]] == ord("}"))
        bad[row[shut[~fits]]] = True
        # Tokens in order; strings by their opening quote.
        texts = quotes[(np.arange(len(quotes)) - before[row_of(quotes)]) & 1 == 0]
        places = np.concatenate([signs, texts, start])
        order = np.argsort(places, kind="stable")
        token = np.concatenate([kind, np.full(len(texts), ord("s")), np.full(len(start), ord("v"))])[order]
        in_object = np.zeros(len(signs), bool)
        in_object[own >= 0] = data[opener[own[own >= 0]]] == ord("{")
        in_object = np.concatenate([in_object, np.zeros(len(texts) + len(start), bool)])[order]
        top = np.concatenate([depth[1:] <= depth[first][row], np.zeros(len(texts) + len(start), bool)])[order]
        of = row_of(places[order])
        edge = np.r_[True, of[1:] != of[:-1]] if len(of) else np.zeros(0, bool)
        value = (token == ord("s")) | (token == ord("v")) | _IS_OPEN[token]
        comma = token == _COMMA
        wants_key = (token == ord("{")) | (comma & in_object)
        wants_value = (token == ord("[")) | (comma & ~in_object) | (token == _COLON)
        previous_key, previous_value = np.r_[False, wants_key[:-1]], np.r_[False, wants_value[:-1]]
        previous_key[edge], previous_value[edge] = False, False
        named = (token == ord("s")) & previous_key
        after_name = np.r_[False, named[:-1]] & ~edge
        was = np.r_[0, token[:-1]]
        empty = ((was == ord("{")) & (token == ord("}")) | (was == ord("[")) & (token == ord("]"))) & ~edge
        rest = _IS_CLOSE[token] | comma
        fits = np.where(edge, value, np.where(previous_key, named | empty, np.where(previous_value, value | empty, np.where(after_name, token == _COLON, rest))))
        fits &= ~((comma | (token == _COLON)) & top)
        bad[of[~fits]] = True
        some = np.zeros(rows, bool)
        some[of] = True
        return ~bad & some

    def of(self, containers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values directly in each container and, for each, the index into containers: a list offset expansion."""
        low, high = np.searchsorted(self._sorted, containers), np.searchsorted(self._sorted, containers, side="right")
        counts = high - low
        parents = np.repeat(np.arange(len(containers)), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return self._order[np.repeat(low, counts) + inside], parents

    def member(self, containers: np.ndarray, key: str) -> tuple[np.ndarray, np.ndarray]:
        """The value under a key of each container that has it, the last one if it is repeated, and the index into containers."""
        values, parents = self.of(containers)
        hit = self.key[values] == KEYS.index(key)
        values, parents = values[hit], parents[hit]
        last = np.r_[parents[1:] != parents[:-1], True] if len(parents) else hit[:0]
        return values[last], parents[last]

    def objects(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Objects in the arrays that values are, or values themselves: containers, positions, index into values."""
        single = np.flatnonzero(self.first[values] == ord("{"))
        lists = np.flatnonzero(self.first[values] == ord("["))
        entries, parents = self.of(self.child[values[lists]])
        kept = self.first[entries] == ord("{")
        entries, parents = entries[kept], lists[parents[kept]]
        return np.concatenate([self.child[values[single]], self.child[entries]]), np.concatenate([np.zeros(len(single), np.int64), self.position[entries]]), np.concatenate([single, parents])

    def pages(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The page object of each text and its row."""
        values, row = self.of(-1 - np.arange(rows))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        boxes, _, at = self.objects(values)
        row, done, roots = row[at], np.zeros(rows, bool), (boxes, row[at])
        while len(boxes):
            pages, parent = self.member(boxes, "Page")
            inner, place, of = self.objects(pages)
            owner = row[parent[of]]
            order = np.lexsort((place, owner))
            owner, inner = owner[order], inner[order]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]] & ~done[owner]) if len(owner) else np.zeros(0, np.int64)
            found.append((inner[first], owner[first]))
            done[row[parent]] = True
            values, parent = self.of(boxes)
            wrapped = (self.first[values] == ord("{")) & ~done[row[parent]] & (self.key[values] != KEYS.index("regions"))
            values, parent = values[wrapped], parent[wrapped]
            if len(values) > 1:  # of a repeated key the last value counts
                name = _unescaped(_slices(self.data, self.key_begin[values], self.key_end[values])).dictionary_encode().indices.to_numpy()
                last = np.sort(len(values) - 1 - np.unique((parent * (int(name.max()) + 1) + name)[::-1], return_index=True)[1])
                values, parent = values[last], parent[last]
            boxes, row = self.child[values], row[parent]
        bare = ~done[roots[1]]
        found.append((roots[0][bare], roots[1][bare]))
        return np.concatenate([c for c, _ in found]), np.concatenate([r for _, r in found])

    def points(self, polygons: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Each point of the polygon values: index into polygons, position, its text."""
        target, owner = polygons, np.arange(len(polygons))
        boxes = np.flatnonzero(self.first[polygons] == ord("{"))
        inner, parent = self.member(self.child[polygons[boxes]], "points")
        bare = np.ones(len(boxes), bool)
        bare[parent] = False
        keep = self.first[polygons] != ord("{")
        keep[boxes[bare]] = True
        target, owner = np.concatenate([target[keep], inner]), np.concatenate([owner[keep], boxes[parent]])
        single = np.flatnonzero(self.first[target] == ord("{"))
        x, at = self.member(self.child[target[single]], "x")
        single = single[np.unique(at)]
        lists = np.flatnonzero(self.first[target] == ord("["))
        entries, parents = self.of(self.child[target[lists]])
        kept = (_IS_OPEN[self.first[entries]] | (self.first[entries] == _QUOTE))
        entries, parents = entries[kept], lists[parents[kept]]
        values = np.concatenate([target[single], entries])
        owners = np.concatenate([owner[single], owner[parents]])
        places = np.concatenate([np.zeros(len(single), np.int64), self.position[entries]])
        texts = _slices(self.data, self.begin[values], self.end[values])
        strings = np.flatnonzero(self.first[target] == _QUOTE)
        if len(strings):
            inside = _slices(self.data, self.begin[target[strings]], self.end[target[strings]]).cast(pa.string())
            parts = pc.split_pattern_regex(pc.utf8_trim(inside, '" \t\r\n'), r"(?:\s|\\[ntr])+")
            flat, up = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
            offsets = parts.offsets.to_numpy()
            where = np.arange(len(flat)) - (offsets[up] - offsets[0])
            full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
            owners, places = np.concatenate([owners, owner[strings[up[full]]]]), np.concatenate([places, where[full]])
            texts = pa.concat_arrays([texts.cast(pa.string()), flat.filter(pa.array(full)).cast(pa.string())])
        return owners, places, texts.cast(pa.string())

    def strings(self, containers: np.ndarray, key: str) -> pa.Array:
        """The text under a key of each container; null where it is missing, null or no string."""
        values, parents = self.member(containers, key)
        text = self.first[values] == _QUOTE
        values, parents = values[text], parents[text]
        ends = self.closing[np.searchsorted(self.closing, self.begin[values]) + 1] if len(values) else values
        at = np.full(len(containers), -1)
        at[parents] = np.arange(len(values))
        return _unescaped(_slices(self.data, self.begin[values] + 1, ends)).take(pa.array(at, mask=at < 0))


def _containers(data: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each structural sign its kind, whether it opens or closes, its level, and its container's number (of an opening or closing sign the one it bounds), -1 for none.

    Signs of one level stand in order as opening sign, commas and colons, closing sign, so that the latest opening one is the container: one sort by level, whatever the depth.
    """
    kind = data[signs]
    opens, closes = _IS_OPEN[kind], _IS_CLOSE[kind]
    level = np.cumsum(opens.astype(np.int64) - closes) + closes
    number = np.where(opens, np.cumsum(opens) - 1, -1)
    order = np.argsort(level, kind="stable")
    new = np.r_[True, level[order][1:] != level[order][:-1]] if len(order) else opens
    # Numbers grow within a level; adding an offset by level keeps the running maximum from reaching across.
    base = (np.cumsum(new) - 1) * (len(signs) + 1)
    latest = np.maximum.accumulate(np.where(number[order] >= 0, number[order] + 1, 0) + base) - base - 1 if len(order) else number
    own = np.empty(len(signs), np.int64)
    own[order] = latest
    return kind, opens, closes, level, own


_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def _coordinates(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """x and y of points written as [x,y], {"x":x,"y":y} or x,y, numbers or strings; null where there is none."""
    named = pc.starts_with(texts, "{")
    plain = pc.extract_regex(texts, rf"^[\[\s\"]*(?P<x>{_NUMBER})[\"\s]*,[\"\s]*(?P<y>{_NUMBER})")
    out = []
    for c in "xy":
        keyed = pc.struct_field(pc.extract_regex(texts, rf'"{c}"\s*:\s*"?\s*(?P<v>{_NUMBER})'), [0])
        out.append(pc.cast(pc.if_else(named, keyed, pc.struct_field(plain, [c])), pa.float64()))
    return out[0], out[1]


def flatten(payloads: pa.Array, keys: pa.Array, values: bool) -> Iterator[pa.RecordBatch]:
    """Rows of regions, lines and points of one slice of payloads, in the order regions, region points, lines, line points a level."""
    payloads = pc.fill_null(payloads.cast(pa.large_string()), "").cast(pa.large_binary())
    if not len(payloads):
        return
    offsets = np.frombuffer(payloads.buffers()[1], np.int64)[payloads.offset : payloads.offset + len(payloads) + 1]
    tree = Values(np.frombuffer(payloads.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0])

    def batch(row, path, line, point, boxes=None, id_key=None, texts=None) -> pa.RecordBatch:
        n = len(row)
        columns = [keys.take(pa.array(row)), path, pa.array(line, pa.int32()), pa.array(point, pa.int32())]
        if values:
            nulls, no = pa.nulls(n, pa.string()), pa.nulls(n, pa.float64())
            columns += [tree.strings(boxes, id_key), tree.strings(boxes, "transcription"), no, no] if boxes is not None else [nulls, nulls, *_coordinates(texts)]
        return pa.RecordBatch.from_arrays(columns, names=[*FOUND, *DETAIL][: len(columns)])

    def points(boxes: np.ndarray, row, path, line) -> pa.RecordBatch:
        polygons, box = tree.member(boxes, "polygon")
        owner, place, texts = tree.points(polygons)
        at = box[owner]
        return batch(row[at], path.take(pa.array(at)), line[at], place, texts=texts)

    boxes, row = tree.pages(len(keys))
    path: pa.Array | None = None
    while len(boxes):
        listed, parent = tree.member(boxes, "regions")
        inner, place, of = tree.objects(listed)
        parent = parent[of]
        step = pa.array(place).cast(pa.string())
        path = step if path is None else pc.binary_join_element_wise(path.take(pa.array(parent)), step, ".")
        boxes, row = inner, row[parent]
        none = np.full(len(boxes), -1)
        yield batch(row, path, none, none, boxes, "region_id")
        yield points(boxes, row, path, none)
        listed, parent = tree.member(boxes, "lines")
        lines, number, of = tree.objects(listed)
        at = parent[of]
        line_path, line_row = path.take(pa.array(at)), row[at]
        yield batch(line_row, line_path, number, np.full(len(lines), -1), lines, "line_id")
        yield points(lines, line_row, line_path, number)


FOUND = ("page_id", "region_path", "line_no", "point_no")
DETAIL = ("item_id", "transcription", "x", "y")
FOUND_SCHEMA = "page_id bigint, region_path string, line_no int, point_no int"
DETAIL_SCHEMA = FOUND_SCHEMA + ", item_id string, transcription string, x double, y double"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together, for payloads whose levels have few rows each."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= OUT_ROWS or size >= OUT_BYTES:
            yield pa.concat_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def _flatten_batches(values: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, keys = batch.column("payload").cast(pa.large_string()), batch.column("page_id")
            sizes = np.cumsum(pc.fill_null(pc.binary_length(payloads), 0).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(sizes // SLICE_BYTES)) + 1, len(payloads)])
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                yield from _gathered(flatten(payloads.slice(low, high - low), keys.slice(low, high - low), values))

    return run


def current(annotations: DataFrame) -> DataFrame:
    """page_id, payload of each page once. Pages without copies stay where they are; only those with copies move."""
    pages = spread(pick(annotations, "page_id", "loaded_at", "payload"))
    stamp = F.struct("loaded_at", F.md5("payload").alias("h"))
    repeated = pages.groupBy("page_id").agg(F.count("*").alias("n"), F.max(stamp).alias("latest")).where("n > 1").select(F.col("page_id").alias("of"), "latest")
    repeated = materialise(repeated, "repeated")
    single = pages.join(repeated, F.col("page_id").eqNullSafe(F.col("of")), "left_anti").select("page_id", "payload")
    latest = pages.join(repeated, F.col("page_id").eqNullSafe(F.col("of"))).where(stamp.eqNullSafe(F.col("latest")))
    return single.union(latest.groupBy("page_id").agg(F.max("payload").alias("payload")))


def nodes(annotations: DataFrame, values: bool = True) -> DataFrame:
    """One row for each region, line and polygon point of each page, keyed by (page_id, region_path, line_no, point_no).

    values: with the id and transcription of regions and lines and the coordinates of points.
    """
    return current(annotations).where("payload is not null").mapInArrow(_flatten_batches(values), DETAIL_SCHEMA if values else FOUND_SCHEMA)


def regions(flat: DataFrame) -> DataFrame:
    """Regions with the path of the region they are in, null at the page's level."""
    parent = F.nullif(F.regexp_extract("region_path", r"^(.*)\.\d+$", 1), F.lit(""))
    return flat.where("line_no = -1 and point_no = -1").select("page_id", "region_path", parent.alias("parent_path"), F.col("item_id").alias("region_id"), "transcription")


def lines(flat: DataFrame) -> DataFrame:
    """Lines with the path of their region."""
    return flat.where("line_no >= 0 and point_no = -1").select("page_id", "region_path", "line_no", F.col("item_id").alias("line_id"), "transcription")


def points(flat: DataFrame) -> DataFrame:
    """Polygon points with their region and, unless -1, line."""
    return flat.where("point_no >= 0").select("page_id", "region_path", "line_no", "point_no", "x", "y")
