"""Crops of page images: the rectangle around a polygon, white outside it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow import kernels
from docflow.functions import geometry as G
from docflow.functions import png


def crop(image: np.ndarray, polygon: np.ndarray) -> np.ndarray:
    """The pixels inside a polygon on white, cut to the part of its rectangle that lies on the image. A polygon off the image raises ValueError."""
    height, width = image.shape[:2]
    points = np.rint(np.asarray(polygon, float)).astype(int).reshape(-1, 2)
    (x1, y1), (x2, y2) = np.maximum(points.min(axis=0), 0), np.minimum(points.max(axis=0) + 1, (width, height))
    if x1 >= x2 or y1 >= y2:
        raise ValueError("nothing of the polygon is on the image")
    out = image[y1:y2, x1:x2].copy()
    out[~kernels.rasterise(points - (x1, y1), x2 - x1, y2 - y1)] = 255
    return out


def _points(text: str) -> np.ndarray:
    return np.array([p.split(",") for p in text.split()], float).reshape(-1, 2)


def crop_images(pages: DataFrame, polygons: DataFrame, page: str = "page") -> DataFrame:
    """polygons' columns but the polygon, and image: the crop of each as PNG, null where the page's bytes can't be read or the polygon is off the page.

    pages: page, image (PNG). Polygons of a page are packed into one row first, so a page's bytes move and are decoded once.
    """
    keys = [c for c in polygons.columns if c not in (page, "polygon")]
    packed = polygons.groupBy(page).agg(F.collect_list(F.struct(*keys, G.format_points(F.col("polygon")).alias("_points"))).alias("items")).join(pages.select(page, "image"), page)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, items, data in zip(batch[page], batch["items"], batch["image"], strict=True):
                try:
                    image = png.decode(bytes(data))
                except (ValueError, TypeError):
                    image = None
                rows = []
                for item in items:
                    try:
                        found = None if image is None else png.encode(crop(image, _points(item["_points"])))
                    except (ValueError, TypeError):
                        found = None
                    rows.append({page: name, **{k: item[k] for k in keys}, "image": found})
                yield pd.DataFrame(rows, columns=[page, *keys, "image"])

    kinds = ", ".join(f"{c} {polygons.schema[c].dataType.simpleString()}" for c in [page, *keys])
    return packed.mapInPandas(cut, f"{kinds}, image binary")


def page_images(lines: DataFrame, page: str = "page", scale: int = 10, width: int = 180, height: int = 240) -> DataFrame:
    """page, image: a small grey picture of each page with its lines' polygons in black; stands in for scans in tests."""
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            images = []
            for polygons in batch["polygons"]:
                image = np.full((height, width), 200, np.uint8)
                for polygon in polygons:
                    image[kernels.rasterise(_points(polygon) / scale, width, height)] = 0
                images.append(png.encode(image))
            yield pd.DataFrame({page: batch[page], "image": images})

    return lines.groupBy(page).agg(F.collect_list(G.format_points(F.col("polygon"))).alias("polygons")).mapInPandas(draw, f"{page} {lines.schema[page].dataType.simpleString()}, image binary")
