"""Text functions that Spark lacks, as Arrow kernels."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def to_strings(points: np.ndarray, row: np.ndarray, rows: int, valid: np.ndarray) -> pa.Array:
    """The string array of code points that belong to ascending rows."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    offsets = np.zeros(rows + 1, np.int64)
    np.cumsum(np.bincount(row, weights=width, minlength=rows).astype(np.int64), out=offsets[1:])
    out = pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pc.if_else(pa.array(valid), out, pa.scalar(None, pa.large_string())).cast(pa.string())


def _ranked(texts: list[pa.Array]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of the white-space separated words of several arrays of texts: each word's row and its number among the distinct words of its row in all arrays, and where each row's numbers begin."""
    rows, words = [], []
    for column in texts:
        parts = pc.utf8_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
        flat, up = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
        full = pc.not_equal(flat, "")
        words.append(flat.filter(full))
        rows.append(up[full.to_numpy(zero_copy_only=False)].astype(np.int64))
    ids = pa.concat_arrays(words).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    every = np.concatenate(rows)
    keys, number = np.unique(every * (int(ids.max(initial=0)) + 1) + ids, return_inverse=True)
    begin = np.searchsorted(keys // (int(ids.max(initial=0)) + 1), np.arange(len(texts[0]) + 1))
    cuts = np.cumsum([len(r) for r in rows])[:-1]
    return rows, np.split(number, cuts), begin


_COMPARED = StructType([StructField("truth", StringType()), StructField("read", StringType()), *(StructField(n, IntegerType()) for n in ("n_truth", "n_read", "hits"))])


@F.arrow_udf(_COMPARED)
def compared_words(truth: pa.Array, read: pa.Array) -> pa.Array:
    """Both texts with a character for each word, equal for equal words; the numbers of words; and how many of them, as multisets, both have.

    Linear in the words. A pair may have a million distinct words. Null where a text is null.
    """
    rows, numbers, begin = _ranked([truth, read])
    n = len(truth)
    valid = pc.and_(pc.is_valid(truth), pc.is_valid(read)).to_numpy(zero_copy_only=False)
    coded = []
    for row, number in zip(rows, numbers, strict=True):
        code = 0x100 + number - begin[row]
        code = np.where(code >= 0xD800, code + 0x2800, code)  # no surrogates, nor the marks of byte order after them
        coded.append(to_strings(code, row, n, valid))
    counts = [np.bincount(number, minlength=begin[-1]) for number in numbers]
    common = np.r_[0, np.cumsum(np.minimum(*counts))]
    sizes = [np.bincount(row, minlength=n) for row in rows]
    columns = [*coded, *(pa.array(x.astype(np.int32)) for x in (*sizes, common[begin[1:]] - common[begin[:-1]]))]
    return pa.StructArray.from_arrays(columns, names=["truth", "read", "n_truth", "n_read", "hits"], mask=pa.array(~valid))


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Canonically composed text; null stays null. By unicodedata, as Arrow's NFC kernel leaves marks decomposed; texts of composed Latin signs only are left as they are."""
    odd = pc.fill_null(pc.match_substring_regex(text, r"[^\x00-\x{24f}]"), False)
    if not pc.any(odd).as_py():
        return text.cast(pa.string())
    composed = pa.array([unicodedata.normalize("NFC", t) for t in text.filter(odd).to_pylist()], pa.string())
    return pc.replace_with_mask(text.cast(pa.string()), odd, composed)


@F.arrow_udf(StringType())
def nfd(text: pa.Array) -> pa.Array:
    """Canonically decomposed text, by an Arrow kernel; null stays null."""
    return pc.utf8_normalize(text, "NFD")
