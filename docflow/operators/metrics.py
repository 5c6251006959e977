"""Scores of transcriptions, boxes and masks as exactly additive DataFrame aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow import kernels
from docflow.functions import geometry as G
from docflow.functions import ratios as R


def join_pages(truth: DataFrame, read: DataFrame, key: str = "page") -> DataFrame:
    """Predictions with the truth of the same page, by key and not by position."""
    return truth.join(read, key)


def text_of(lines: DataFrame, group: list[str], order: list[str], text: str, separator: str = " ") -> DataFrame:
    """The lines of each group joined in order; the text of an empty group is ''."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return lines.groupBy(*group).agg(F.array_join(F.transform(parts, lambda p: p["_text"]), separator).alias(text))


def texts_of(lines: DataFrame, group: list[str], order: list[str], *texts: str, separator: str = " ") -> DataFrame:
    """As text_of for several texts of a line at once."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *(F.col(t).alias(f"_{i}") for i, t in enumerate(texts)))))
    joined = lines.groupBy(*group).agg(rows.alias("_rows"))
    part = lambda i: F.array_join(F.transform("_rows", lambda r: r[f"_{i}"]), separator)
    return joined.select(*group, *(part(i).alias(t) for i, t in enumerate(texts)))


def score_text(pairs: DataFrame, group: list[str], truth: Column, read: Column) -> DataFrame:
    """Micro-averaged metrics of a group: each metric's parts are summed, then divided."""
    return pairs.withColumn("_m", R.ocr_metrics(truth, read)).groupBy(*group).agg(*R.total_metrics(F.col("_m")))


def score_lines(pairs: DataFrame, group: list[str], truth: Column, read: Column, normalise_by: str = "prediction") -> DataFrame:
    """Micro-averaged line metrics with the rules for empty lines."""
    return pairs.withColumn("_m", R.line_metrics(truth, read, normalise_by)).groupBy(*group).agg(*R.total_metrics(F.col("_m")))


def values(scored: DataFrame, digits: int | None = None) -> DataFrame:
    """Each metric's ratio as its value, rounded if digits are given."""
    shown = lambda m: R.value(F.col(m)) if digits is None else F.round(R.value(F.col(m)), digits)
    return scored.withColumns({m: shown(m) for m in R.METRICS if m in scored.columns})


def matched_annotations(annotations: DataFrame, detections: DataFrame, page: str, least: float = 0.5) -> DataFrame:
    """Annotations that some detection of their page meets at IoU `least` or more: an equi-join on the page, IoU as its condition."""
    a, d = annotations.alias("a"), detections.select(F.col(page).alias("_page"), F.col("box").alias("_box")).alias("d")
    overlap = G.intersection_area(F.col("a.box"), F.col("d._box"))
    union = G.area(F.col("a.box")) + G.area(F.col("d._box")) - overlap
    return a.join(d, (F.col(f"a.{page}") == F.col("d._page")) & (union > 0) & (overlap >= F.lit(least) * union), "left_semi")


def unmatched_annotations(annotations: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    return annotations.join(matched.select(*keys), keys, "left_anti")


def detection_scores(annotations: DataFrame, detections: DataFrame, page: str, least: float = 0.5) -> DataFrame:
    """One row: annotation and detection counts and matches both ways, the list-based precision, recall and F1, and the standard ones.

    ref_precision counts unmatched annotations in place of stray detections, which makes it 1 whenever anything matches;
    precision, recall and f1 are the usual ones.
    """
    flags = ("n_annotations", "n_found", "n_detections", "n_correct")
    counted = [annotations, matched_annotations(annotations, detections, page, least), detections, matched_annotations(detections, annotations, page, least)]
    every = [df.select(*(F.lit(int(own == f)).cast("long").alias(f) for f in flags)) for df, own in zip(counted, flags, strict=True)]
    one = every[0].union(every[1]).union(every[2]).union(every[3]).agg(*(F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in flags))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    recall, precision = share("n_found", "n_annotations"), share("n_correct", "n_detections")
    mean = lambda p, r: F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    exact = F.when(F.col("n_found") > 0, 1.0).otherwise(0.0)
    return one.select("*", exact.alias("ref_precision"), recall.alias("ref_recall"), mean(exact, recall).alias("ref_f1"), precision.alias("precision"), recall.alias("recall"), mean(precision, recall).alias("f1"))


#: Columns of a grid that one bigint holds as bits.
_BITS = 63


def grid_rows(boxes: DataFrame, page: str, side: int, columns: int) -> DataFrame:
    """page, cy, bits: for each row of cells of `side` pixels that a box touches, the columns it touches as bits of as many bigints as `columns` take."""
    x1, y1, x2, y2 = G.corners(F.col("box"))
    span = lambda low, high: (F.floor(low / side).cast("int"), F.floor((high - 1) / side).cast("int"))
    (low, high), rows = span(x1, x2), span(y1, y2)

    def bits(word: int) -> Column:
        first, last = F.greatest(low - word * _BITS, F.lit(0)), F.least(high - word * _BITS, F.lit(_BITS - 1))
        ones = F.call_function("shiftright", F.lit((1 << _BITS) - 1), F.lit(_BITS - 1) - last + first)
        return F.when(first <= last, F.call_function("shiftleft", ones, first)).otherwise(F.lit(0).cast("long"))

    whole = boxes.where((x2 > x1) & (y2 > y1))
    return whole.select(page, F.explode(F.sequence(*rows)).alias("cy"), *(bits(w).alias(f"b{w}") for w in range(-(-columns // _BITS))))


def cell_scores(truth: DataFrame, read: DataFrame, page: str, side: int, columns: int, rows: int) -> DataFrame:
    """Mask scores of each page's boxes on a grid of cells of `side` pixels: coverage, IoU, Dice, pixel accuracies.

    A row of cells is a few bigints, so boxes are joined by bit_or with a partial step: what moves is rows of cells, not cells.
    """
    words = range(-(-columns // _BITS))
    sides = [grid_rows(boxes, page, side, columns).select(page, "cy", *((F.col(f"b{w}") if own == name else F.lit(0).cast("long")).alias(f"{own}{w}") for own in "tp" for w in words)) for boxes, name in ((truth, "t"), (read, "p"))]
    joined = sides[0].union(sides[1]).groupBy(page, "cy").agg(*(F.bit_or(f"{own}{w}").alias(f"{own}{w}") for own in "tp" for w in words))
    count = lambda bits: F.sum(sum((F.bit_count(bits(w)) for w in words), F.lit(0))).cast("double")
    counts = joined.groupBy(page).agg(count(lambda w: F.col(f"t{w}").bitwiseAND(F.col(f"p{w}"))).alias("tp"), count(lambda w: F.col(f"t{w}")).alias("g"), count(lambda w: F.col(f"p{w}")).alias("p"))
    size = columns * rows
    tp, g, p, none = F.col("tp"), F.col("g"), F.col("p"), F.lit(float(size)) - F.col("g") - F.col("p") + F.col("tp")
    return counts.select(
        page,
        F.when(g == 0, 0.0).otherwise(F.try_divide(tp, g)).alias("region_coverage"),
        (tp / (g + p - tp + 1e-10)).alias("iou"),
        (2 * tp / (p + g + 1e-10)).alias("dice"),
        ((tp + none) / size).alias("pixel_accuracy"),
        ((tp / (g + 1e-10) + none / (size - g + 1e-10)) / 2).alias("mean_pixel_accuracy"),
    )


def box_coverage(truth: DataFrame, read: DataFrame, page: str) -> DataFrame:
    """Exact share of each page's truth area that its detections cover, as the ratio of whole areas; a page is bounded, so one group is one task."""
    tagged = truth.select(page, "box", F.lit(True).alias("is_truth")).union(read.select(page, "box", F.lit(False)))

    def cover(group: pd.DataFrame) -> pd.DataFrame:
        t, p = ([np.array(b, float) for b in group["box"][group["is_truth"] == side]] for side in (True, False))
        area = kernels.union_area
        common = area(t) + area(p) - area(t + p)
        return pd.DataFrame({page: [group[page].iloc[0]], "covered": [int(common)], "area": [int(area(t))]})

    return tagged.groupBy(page).applyInPandas(cover, f"{page} {truth.schema[page].dataType.simpleString()}, covered long, area long")


def polygon_coverage(truth: DataFrame, read: DataFrame, page: str) -> DataFrame:
    """As box_coverage for polygons of any shape (page, polygon): whole areas of the truth's union and of what the other union covers of it."""
    tagged = truth.select(page, "polygon", F.lit(True).alias("is_truth")).union(read.select(page, "polygon", F.lit(False))).where(F.size("polygon") >= 3)

    def cover(group: pd.DataFrame) -> pd.DataFrame:
        t, r = ([np.array([(p["x"], p["y"]) for p in polygon], float) for polygon in group["polygon"][group["is_truth"] == side]] for side in (True, False))
        covered, area = kernels.polygon_coverage(t, r)
        return pd.DataFrame({page: [group[page].iloc[0]], "covered": [int(covered + 1e-6)], "area": [int(area + 1e-6)]})

    return tagged.groupBy(page).applyInPandas(cover, f"{page} {truth.schema[page].dataType.simpleString()}, covered long, area long")


def match_boxes(truth: DataFrame, read: DataFrame, page: str, key: str, least: float = 0.5) -> DataFrame:
    """page, truth key, read key, iou of the best one-to-one assignment by IoU within each page."""
    tagged = truth.select(page, F.col(key).alias("k"), "box", F.lit(True).alias("is_truth")).union(read.select(page, F.col(key), "box", F.lit(False)))

    def match(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        t, p = group[group["is_truth"]], group[~group["is_truth"]]
        iou = kernels.box_iou(np.array(t["box"].tolist(), float), np.array(p["box"].tolist(), float))
        rows, columns = kernels.assign(-iou)
        good = iou[rows, columns] >= least if len(rows) else np.zeros(0, bool)
        return pd.DataFrame({page: group[page].iloc[0] if len(group) else None, "truth_key": t["k"].to_numpy()[rows[good]], "read_key": p["k"].to_numpy()[columns[good]], "iou": iou[rows[good], columns[good]]})

    kinds = truth.schema
    return tagged.groupBy(page).applyInPandas(match, f"{page} {kinds[page].dataType.simpleString()}, truth_key {kinds[key].dataType.simpleString()}, read_key {kinds[key].dataType.simpleString()}, iou double")


def match_masks(polygons: DataFrame, page: str, least: float = 0.5, scale: int = 1) -> DataFrame:
    """Pairs of truth and read polygons of each page by mask IoU with all segmentation metrics; unmatched ones have a null partner.

    polygons: page, k (long), is_truth, polygon. scale: pixels a mask cell. Pages stand behind one another in a task and are
    matched by the Arrow batch, so that a page has no call of its own; one that is longer than a batch is put together.
    """
    rows = polygons.where(F.size("polygon") >= 3).select(page, F.col("k").cast("long").alias("k"), "is_truth", "polygon")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _page_starts(batch.column(0))
            if held and held[-1].column(0)[-1].as_py() != batch.column(0)[0].as_py():
                yield _matched_pages(held, least, scale)
                held = []
            if starts[-1]:
                yield _matched_pages([*held, batch.slice(0, starts[-1])], least, scale)
                held = []
            held.append(batch.slice(starts[-1]))
        if held:
            yield _matched_pages(held, least, scale)

    schema = f"{page} {polygons.schema[page].dataType.simpleString()}, truth_key long, read_key long, " + ", ".join(f"{m} double" for m in MASK_METRICS)
    return rows.repartition(page).sortWithinPartitions(page, "k").mapInArrow(match, schema)


def _page_starts(pages: pa.Array) -> np.ndarray:
    """Rows at which a page begins, of pages that stand together; null is a page."""
    codes = pages.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])


def _matched_pages(batches: list[pa.RecordBatch], least: float, scale: int) -> pa.RecordBatch:
    """Rows of match_masks for whole pages (page, k, is_truth, polygon), each by k."""
    pages, k, is_truth, polygons = pa.Table.from_batches(batches).combine_chunks().to_batches()[0].columns
    starts = _page_starts(pages)
    page = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(pages)]))
    x, y = (polygons.flatten().field(i) for i in ("x", "y"))
    if x.null_count or y.null_count or polygons.flatten().null_count:
        raise ValueError("a point of a polygon is null")
    points = np.stack([x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)], axis=1) / scale
    sizes = pc.list_value_length(polygons).to_numpy(zero_copy_only=False).astype(int)
    ends = np.maximum.reduceat(np.maximum.reduceat(points, np.cumsum(sizes) - sizes), starts)
    width, height = (np.maximum(ends[:, i].astype(int) + 2, 0) for i in (0, 1))
    side = is_truth.to_numpy(zero_copy_only=False).astype(bool)
    t, r, metrics = kernels.match_pages(points, sizes, page, np.flatnonzero(side), np.flatnonzero(~side), width, height, least)
    alone = np.ones(len(side), bool)
    alone[t] = alone[r] = False
    alone = np.flatnonzero(alone)
    key = lambda pair, own: k.take(pa.array(np.r_[pair, alone], mask=np.r_[np.zeros(len(pair), bool), side[alone] != own]))
    no = np.r_[np.zeros(len(t), bool), np.ones(len(alone), bool)]
    values = [pa.array(np.r_[metrics[m], np.zeros(len(alone))], mask=no) for m in MASK_METRICS]
    return pa.RecordBatch.from_arrays([pages.take(pa.array(np.r_[t, alone])), key(t, True), key(r, False), *values], names=["page", "truth_key", "read_key", *MASK_METRICS])


MASK_METRICS = ("iou", "dice", "pixel_accuracy", "mean_pixel_accuracy", "boundary_f1", "region_coverage")


def mean_metrics(matched: DataFrame, group: list[str], metrics: tuple[str, ...] = MASK_METRICS) -> DataFrame:
    """Macro averages over pairs."""
    return matched.groupBy(*group).agg(*(F.avg(m).alias(m) for m in metrics))
