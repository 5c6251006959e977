"""Recognition pipelines as chains of DataFrame steps over pluggable backends.

A backend works on Arrow batches; it is made once a worker from its name. No weights ship with the package: the `stub`
backend derives boxes and texts from its input alone, for tests and plumbing, and says nothing about recognition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.functions import geometry as G
from docflow.operators import layout


class Backend(Protocol):
    """What a recognition model offers; images come as bytes, boxes as (x1, y1, x2, y2)."""

    def detect(self, images: list[bytes], widths: list[int], heights: list[int]) -> list[list[list[float]]]: ...

    def read(self, images: list[bytes]) -> list[str]: ...


class Stub:
    """Deterministic stand-in: two stacked boxes an image, and the bytes as text."""

    def detect(self, images: list[bytes], widths: list[int], heights: list[int]) -> list[list[list[float]]]:
        return [[[0, 0, w, h // 2], [0, h // 2, w, h]] if w and h >= 2 else [] for w, h in zip(widths, heights, strict=True)]

    def read(self, images: list[bytes]) -> list[str]:
        return [bytes(x).decode("utf-8", "replace") for x in images]


BACKENDS: dict[str, Callable[[], Backend]] = {"stub": Stub}


def register(name: str, factory: Callable[[], Backend]) -> None:
    BACKENDS[name] = factory


def detect(images: DataFrame, backend: str, merge: bool = True) -> DataFrame:
    """page, path of boxes so far, position, box for each object found. images: page, crop, image, width, height.

    An image on which the backend fails has no objects; the others of its batch are not affected.
    """
    make = BACKENDS[backend]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            found = []
            for image, w, h in zip(batch["image"], batch["width"], batch["height"], strict=True):
                try:
                    found.append(model.detect([image], [w], [h])[0])
                except Exception:
                    found.append([])
            yield batch[["page", "crop"]].assign(boxes=found)

    boxes = images.select("page", "crop", "image", "width", "height").mapInPandas(run, "page string, crop string, boxes array<array<double>>")
    flat = boxes.select("page", "crop", F.posexplode("boxes").alias("position", "box"))
    if not merge:
        return flat
    keyed = flat.withColumn("group", F.concat_ws("\x1f", "page", "crop"))
    merged = layout.merge_overlapping(keyed, "group", "position")
    return merged.select(F.split("group", "\x1f")[0].alias("page"), F.split("group", "\x1f")[1].alias("crop"), "position", "box")


def read(crops: DataFrame, backend: str) -> DataFrame:
    """crops with text, '' where the backend fails."""
    make = BACKENDS[backend]
    names = crops.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            texts = []
            for image in batch["image"]:
                try:
                    texts.append(model.read([image])[0])
                except Exception:
                    texts.append("")
            yield batch.assign(text=texts)

    kinds = ", ".join(f"{c} {crops.schema[c].dataType.simpleString()}" for c in names)
    return crops.mapInPandas(run, f"{kinds}, text string")


def _into_crops(images: DataFrame, found: DataFrame) -> DataFrame:
    """The crops of found objects as images of their own, boxes of objects on the page beside them.

    Pixels aren't cut here: a backend gets the page's bytes with the crop's box, which is what the models' processors take.
    """
    moved = found.join(images.select("page", "crop", "image", F.col("page_box").alias("parent")), ["page", "crop"])
    x, y, _, _ = G.corners(F.col("parent"))
    on_page = G.shift_box(F.col("box"), x, y)
    crop = F.concat_ws(".", F.nullif("crop", F.lit("")), F.col("position").cast("string"))
    rows = moved.select("page", crop.alias("crop"), "image", on_page.alias("page_box"))
    x1, y1, x2, y2 = G.corners(F.col("page_box"))
    return rows.withColumns({"width": (x2 - x1).cast("int"), "height": (y2 - y1).cast("int")})


#: Steps of each pipeline: objects detected one within the other, then read.
PIPELINES = {
    "region_od__line_od__ocr": ("region", "line"),
    "line_od__line_seg__ocr": ("line", "segment"),
    "line_od__ocr": ("line",),
    "region_od__line_seg__ocr": ("region", "line"),
}


def run(images: DataFrame, name: str, backends: dict[str, str]) -> DataFrame:
    """page, crop (path of positions), page_box, text of every line. images: page, image, width, height.

    backends: the backend of each of the pipeline's steps and of `ocr`. Order within a page is that of crop paths;
    operators.layout puts lines in reading order.
    """
    if name not in PIPELINES:
        raise ValueError(f"{name} is none of {', '.join(PIPELINES)}")
    whole = F.array(F.lit(0.0), F.lit(0.0), F.col("width").cast("double"), F.col("height").cast("double"))
    level = images.select("page", F.lit("").alias("crop"), "image", whole.alias("page_box"), "width", "height")
    for step in PIPELINES[name]:
        level = _into_crops(level, detect(level, backends[step], merge=step != "segment"))
    return read(level, backends["ocr"]).select("page", "crop", "page_box", "text")


def run_config(images: DataFrame, config: dict) -> DataFrame:
    """A pipeline from a parsed configuration: {"pipeline": name, "backends": {step: backend}}."""
    return run(images, config["pipeline"], config["backends"])


def parse_config(text: str) -> dict:
    """The two-level YAML subset that pipeline files use: `key: value` and one level of indented `key: value`."""
    out: dict = {}
    inner: dict | None = None
    for line in text.splitlines():
        bare = line.split("#", 1)[0].rstrip()
        if not bare.strip():
            continue
        key, _, value = bare.strip().partition(":")
        if bare[0].isspace():
            if inner is None:
                raise ValueError(line)
            inner[key] = value.strip().strip("'\"")
        elif value.strip():
            out[key], inner = value.strip().strip("'\""), None
        else:
            inner = out[key] = {}
    return out
