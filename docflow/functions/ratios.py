"""Unnormalised fractions and the text metrics built on them, as Spark columns.

A ratio is struct(a, b) of bigints; ratios add by parts, so partial sums are exact, and a ratio's value is 0.0 where b is 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow.functions.text import compared_words

METRICS = ("cer", "wer", "bow_hits", "bow_extras")


def ratio(a: Column | int, b: Column | int) -> Column:
    lift = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.struct(lift(a).cast("long").alias("a"), lift(b).cast("long").alias("b"))


def value(r: Column) -> Column:
    return F.when(r["b"] == 0, F.lit(0.0)).otherwise(F.try_divide(r["a"].cast("double"), r["b"].cast("double")))


def total(r: Column) -> Column:
    """The aggregate: the sum by parts, 0/0 over no rows."""
    zero = F.lit(0).cast("long")
    return F.struct(F.coalesce(F.sum(r["a"]), zero).alias("a"), F.coalesce(F.sum(r["b"]), zero).alias("b"))


def fraction(r: Column) -> Column:
    return F.concat_ws("/", r["a"].cast("string"), r["b"].cast("string"))


def parse(text: Column) -> Column:
    """The ratio that fraction() wrote."""
    parts = F.split(text, "/")
    return ratio(parts[0], parts[1])


def cer(truth: Column, read: Column) -> Column:
    """Character errors over the characters of the truth."""
    return ratio(F.levenshtein(truth, read), F.length(truth))


def wer(truth: Column, read: Column) -> Column:
    """Word errors over the words of the truth: the built-in levenshtein over texts with a character for each word."""
    words = compared_words(truth, read)
    return ratio(F.levenshtein(words["truth"], words["read"]), words["n_truth"])


def bag_of_words(truth: Column, read: Column) -> tuple[Column, Column]:
    """Hits: words of the truth that were read, over its words. Extras: words read beyond the truth, over the words read. Both as multisets."""
    words = compared_words(truth, read)
    return ratio(words["hits"], words["n_truth"]), ratio(words["n_read"] - words["hits"], words["n_read"])


def ocr_metrics(truth: Column, read: Column) -> Column:
    """struct(cer, wer, bow_hits, bow_extras)."""
    hits, extras = bag_of_words(truth, read)
    return F.struct(cer(truth, read).alias("cer"), wer(truth, read).alias("wer"), hits.alias("bow_hits"), extras.alias("bow_extras"))


def line_metrics(truth: Column, read: Column, normalise_by: str = "prediction") -> Column:
    """Metrics of a line. Both texts empty: 0/0; one empty: n/n for all four, n the length of the other.

    normalise_by: `prediction` divides by the read text, `reference` by the truth.
    """
    if normalise_by not in ("prediction", "reference"):
        raise ValueError(normalise_by)
    n = F.greatest(F.length(truth), F.length(read))
    alone = lambda r: F.struct(*(r.alias(m) for m in METRICS))
    full = ocr_metrics(truth, read) if normalise_by == "reference" else ocr_metrics(read, truth)
    return F.when((truth == "") & (read == ""), alone(ratio(0, 0))).when((truth == "") | (read == ""), alone(ratio(n, n))).otherwise(full)


def total_metrics(metrics: Column) -> list[Column]:
    """The aggregates of a metrics struct, one ratio a metric."""
    return [total(metrics[m]).alias(m) for m in METRICS]
