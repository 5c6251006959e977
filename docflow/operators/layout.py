"""Reading order and merging of boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow import kernels
from docflow.functions import geometry as G
from docflow.operators import metrics


def cover_bbox(boxes: DataFrame, group: list[str]) -> DataFrame:
    """The box around all boxes of a group."""
    x1, y1, x2, y2 = G.corners(F.col("box"))
    return boxes.groupBy(*group).agg(F.array(F.min(x1), F.min(y1), F.max(x2), F.max(y2)).alias("cover"))


def location(box: Column, printspace: Column) -> Column:
    """Where a box's centre lies: 0 top margin, 1 printspace, 2 bottom margin, 3 left margin, 4 right margin."""
    x1, y1, x2, y2 = G.corners(box)
    left, top, right, bottom = G.corners(printspace)
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    return F.when(cx < left, 3).when(cx > right, 4).when(cy < top, 0).when(cy > bottom, 2).otherwise(1)


def order_with_margins(boxes: DataFrame, page: str, tie: str) -> DataFrame:
    """position of each box in its page's reading order: half of a spread, location, top edge, then tie.

    boxes: page, box, printspace (box), two_pages (boolean) and tie, a key that settles equal places.
    """
    x1, _, x2, _ = G.corners(F.col("box"))
    left, _, right, _ = G.corners(F.col("printspace"))
    second = F.col("two_pages") & ((x1 + x2) > (left + right))
    window = Window.partitionBy(page).orderBy(second, location(F.col("box"), F.col("printspace")), G.corners(F.col("box"))[1], tie)
    return boxes.withColumn("position", (F.row_number().over(window) - 1).cast("int"))


def page_texts(ordered: DataFrame, page: str, detected: str, text: str, legacy_text_order: bool = False) -> DataFrame:
    """The text of each page: its lines' texts in reading order (position), or with legacy_text_order as they were detected, joined by blanks."""
    order = detected if legacy_text_order else "position"
    return metrics.text_of(ordered.where(F.col(text).isNotNull()), [page], [order], text)


def order_columns(boxes: DataFrame, page: str, tie: str, split_x: Column | None = None) -> DataFrame:
    """position in two columns, left before right, each by top then left edge. split_x: by default the page's upper median centre."""
    x1, y1, x2, _ = G.corners(F.col("box"))
    centre = (x1 + x2) / 2
    if split_x is None:
        rank = Window.partitionBy(page).orderBy(centre)
        ranked = boxes.select(page, centre.alias("c"), (F.row_number().over(rank) - 1).alias("r"), F.floor(F.count("*").over(Window.partitionBy(page)) / 2).alias("half"))
        boxes, split_x = boxes.join(ranked.where("r = half").select(page, F.col("c").alias("_split")), page), F.col("_split")
    window = Window.partitionBy(page).orderBy((centre >= split_x).cast("int"), y1, x1, tie)
    return boxes.withColumn("position", (F.row_number().over(window) - 1).cast("int")).drop("_split")


def order_bands(boxes: DataFrame, page: str, tie: str, threshold: int = 10) -> DataFrame:
    """position by bands from top to bottom, each from left to right.

    A band begins with a box more than threshold below the first box of the band before. The fold over the page's sorted
    boxes is a higher-order function; a page is bounded.
    """
    x1, y1, _, _ = G.corners(F.col("box"))
    rows = boxes.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(y1.alias("y"), x1.alias("x"), F.col(tie).alias("k")))).alias("rows"))
    start = F.struct(F.lit(-1).alias("band"), F.lit(None).cast("int").alias("anchor"), F.slice(F.transform("rows", lambda r: F.lit(0)), 1, 0).alias("bands"))

    def step(state: Column, r: Column) -> Column:
        fresh = state["anchor"].isNull() | (F.abs(r["y"] - state["anchor"]) > threshold)
        band = state["band"] + fresh.cast("int")
        return F.struct(band.alias("band"), F.when(fresh, r["y"]).otherwise(state["anchor"]).alias("anchor"), F.concat(state["bands"], F.array(band)).alias("bands"))

    banded = rows.withColumn("bands", F.aggregate("rows", start, step)["bands"])
    ordered = F.array_sort(F.zip_with("bands", "rows", lambda b, r: F.struct(b.alias("band"), r["x"].alias("x"), r["y"].alias("y"), r["k"].alias("k"))))
    return banded.select(page, F.posexplode(ordered).alias("position", "r")).select(page, F.col("r.k").alias(tie), F.col("r.band").alias("band"), "position")


def merge_overlapping(boxes: DataFrame, page: str, order: str, iou: float = 0.2, cover: float = 0.5) -> DataFrame:
    """Each page's boxes merged greedily in the given order; the result depends on it, so order must be unique in a page."""

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        found = kernels.merge_boxes(np.array(group.sort_values(order)["box"].tolist(), float), iou, cover)
        return pd.DataFrame({page: group[page].iloc[0], "position": np.arange(len(found)), "box": found.tolist()})

    return boxes.groupBy(page).applyInPandas(merged, f"{page} {boxes.schema[page].dataType.simpleString()}, position int, box array<double>")


def clip_to_regions(lines: DataFrame, regions: DataFrame, keys: list[str], key: str) -> DataFrame:
    """keys, key and the polygon of each line clipped to its region, moved to the region's origin; under three points it is dropped.

    lines: keys, key, polygon; regions: keys, region_polygon, of any shape. Of several parts the largest is kept.
    """
    joined = lines.select(*keys, key, "polygon").join(regions.select(*keys, "region_polygon"), keys)

    def clip(batches):
        for batch in batches:
            out = []
            for line, region in zip(batch["polygon"], batch["region_polygon"], strict=True):
                window = np.array([(p["x"], p["y"]) for p in region], float)
                clipped = kernels.clip_polygon(np.array([(p["x"], p["y"]) for p in line], float), window) - window.min(axis=0)
                out.append([{"x": float(x), "y": float(y)} for x, y in clipped])
            yield batch[[*keys, key]].assign(polygon=out)

    kinds = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in [*keys, key])
    return joined.where("polygon is not null and region_polygon is not null").mapInPandas(clip, f"{kinds}, polygon array<struct<x:double,y:double>>").where(F.size("polygon") >= 3)
