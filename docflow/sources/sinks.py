"""Writers: tables by page or split, JSON, text, CSV, training layouts and PAGE-XML."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions import geometry as G
from docflow.functions import ratios as R


def write_pages(rows: DataFrame, path: str, page: str = "page") -> None:
    """A parquet table with a folder a page; rows of a page are brought together first, so each folder has one file."""
    rows.repartition(page).write.partitionBy(page).mode("overwrite").parquet(path)


def write_split(samples: DataFrame, path: str) -> None:
    """A parquet table with a folder a split, in place of links into folders."""
    samples.write.partitionBy("split").mode("overwrite").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are kept."""
    rows.write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def write_text(lines: DataFrame, path: str, column: str = "line", linebreak: str = "\n") -> None:
    lines.select(F.col(column).cast("string")).write.option("lineSep", linebreak).mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", "true").mode("overwrite").csv(path)


def write_page_metrics(scored: DataFrame, path: str) -> None:
    """One table of page, hypothesis, reference and each metric as a/b and as a value, in place of three files a page."""
    shown = [c for m in R.METRICS for c in (R.fraction(F.col(m)).alias(f"{m}_str"), R.value(F.col(m)).alias(f"{m}_float"))]
    scored.select(*[c for c in scored.columns if c not in R.METRICS], *shown).write.mode("overwrite").parquet(path)


def yolo_labels(boxes: DataFrame, key: str, order: str, class_id: int = 0) -> DataFrame:
    """key, label: the label file of each image, a line `cls xc yc w h` a box. boxes: key, order, box, width, height.

    Numbers are written as Python writes them, by an Arrow batch function.
    """
    shares = G.yolo_box(F.col("box"), F.col("width"), F.col("height"))
    rows = boxes.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, shares.alias("s")))), lambda r: r["s"])).alias("v"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "label": ["\n".join(f"{class_id} " + " ".join(repr(float(x)) for x in v[i : i + 4]) for i in range(0, len(v), 4)) for v in batch["v"]]})

    return rows.mapInPandas(write, f"{key} {boxes.schema[key].dataType.simpleString()}, label string")


def yolo_polygons(polygons: DataFrame, key: str, order: str, class_id: int = 0) -> DataFrame:
    """key, label: a line `cls x y x y ...` a polygon, six digits a number."""
    shares = G.yolo_polygon(F.col("polygon"), F.col("width"), F.col("height"))
    rows = polygons.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, shares.alias("s")))), lambda r: r["s"]).alias("v"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "label": ["\n".join(f"{class_id} " + " ".join(f"{x:.6f}" for x in s) for s in v) for v in batch["v"]]})

    return rows.mapInPandas(write, f"{key} {polygons.schema[key].dataType.simpleString()}, label string")


def write_yolo(labels: DataFrame, path: str) -> None:
    """labels: split, key, label. One table in the layout's folders; archive.pack turns it into containers of label files."""
    labels.write.partitionBy("split").mode("overwrite").parquet(path)


def write_yolo_files(labels: DataFrame, path: str, names: list[str]) -> None:
    """The layout itself: <split>/labels/<key>.txt for each row of labels (split, key, label) and config.yaml, below a folder that driver and workers share.

    A task that is repeated writes the same files again. For many files write_yolo or archive.pack is the better layout.
    """
    root = re.sub("^file:/+", "/", path)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for split, key, label in zip(batch["split"], batch["key"], batch["label"], strict=True):
                folder = os.path.join(root, split, "labels")
                os.makedirs(folder, exist_ok=True)
                with open(os.path.join(folder, f"{key}.txt"), "w", encoding="utf-8") as file:
                    file.write(label)
            yield pd.DataFrame({"n": [len(batch)]})

    labels.select("split", "key", "label").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    os.makedirs(root, exist_ok=True)
    with open(os.path.join(root, "config.yaml"), "w", encoding="utf-8") as file:
        file.write(yolo_config(names, root))


def yolo_config(names: list[str], root: str) -> str:
    """The layout's configuration as YAML text."""
    return "\n".join([f"path: {root}", "train: train/images", "val: val/images", "test: test/images", f"nc: {len(names)}", "names: [" + ", ".join(f"'{n}'" for n in names) + "]", ""])


def _escaped(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def page_xml(lines: DataFrame, page: str, region: str, order: str) -> DataFrame:
    """page, xml: a Page element of each page with its regions and lines. lines: page, region, order, line_id, polygon, transcription."""
    escaped = _escaped
    coords = lambda polygon: F.concat(F.lit('<Coords points="'), G.format_points(polygon), F.lit('"/>'))
    equiv = lambda text: F.concat(F.lit("<TextEquiv><Unicode>"), escaped(text), F.lit("</Unicode></TextEquiv>"))
    line = F.concat(F.lit('<TextLine id="'), escaped(F.col("line_id")), F.lit('">'), coords(F.col("polygon")), equiv(F.col("transcription")), F.lit("</TextLine>"))
    points = F.flatten(F.collect_list("polygon"))
    rows = F.array_sort(F.collect_list(F.struct(order, line.alias("x"), F.col("transcription").alias("t"))))
    per_region = lines.groupBy(page, region).agg(rows.alias("rows"), points.alias("points"), F.min(order).alias("first"))
    body = F.concat(
        F.lit('<TextRegion id="'), escaped(F.col(region)), F.lit('">'), coords(G.bbox_polygon(G.polygon_bbox(F.col("points")))),
        F.array_join(F.transform("rows", lambda r: r["x"]), ""), equiv(F.array_join(F.transform("rows", lambda r: r["t"]), "\n")), F.lit("</TextRegion>"),
    )
    per_page = per_region.select(page, F.struct("first", body.alias("x")).alias("s")).groupBy(page).agg(F.array_sort(F.collect_list("s")).alias("rs"))
    return per_page.select(page, F.concat(F.lit('<Page imageFilename="'), escaped(F.col(page)), F.lit('.jpg">'), F.array_join(F.transform("rs", lambda r: r["x"]), ""), F.lit("</Page>")).alias("xml"))


def alto_xml(lines: DataFrame, page: str, region: str, order: str) -> DataFrame:
    """page, xml: an alto element of each page: a TextBlock a region with a TextLine a line, which has its text as one String. lines: page, region, order, line_id, polygon, transcription."""
    x1, y1, x2, y2 = G.corners(G.polygon_bbox(F.col("polygon")))
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"'))
    place = F.concat(attribute("HPOS", x1), attribute("VPOS", y1), attribute("WIDTH", x2 - x1), attribute("HEIGHT", y2 - y1))
    shape = F.concat(F.lit("<Shape><Polygon"), attribute("POINTS", G.format_points(F.col("polygon"))), F.lit("/></Shape>"))
    line = F.concat(F.lit("<TextLine"), attribute("ID", _escaped(F.col("line_id"))), place, F.lit(">"), shape, F.lit("<String"), attribute("CONTENT", _escaped(F.col("transcription"))), F.lit("/></TextLine>"))
    rows = F.array_sort(F.collect_list(F.struct(order, line.alias("x"))))
    per_region = lines.groupBy(page, region).agg(rows.alias("rows"), F.min(order).alias("first"))
    block = F.concat(F.lit("<TextBlock"), attribute("ID", _escaped(F.col(region))), F.lit(">"), F.array_join(F.transform("rows", lambda r: r["x"]), ""), F.lit("</TextBlock>"))
    per_page = per_region.select(page, F.struct("first", block.alias("x")).alias("s")).groupBy(page).agg(F.array_sort(F.collect_list("s")).alias("rs"))
    source = F.concat(F.lit("<alto><Description><sourceImageInformation><fileName>"), _escaped(F.col(page)), F.lit(".jpg</fileName></sourceImageInformation></Description><Layout><Page><PrintSpace>"))
    return per_page.select(page, F.concat(source, F.array_join(F.transform("rs", lambda r: r["x"]), ""), F.lit("</PrintSpace></Page></Layout></alto>")).alias("xml"))


def page_json(lines: DataFrame, page: str, region: str, order: str) -> DataFrame:
    """Page records (schema.PAGE) of lines: regions with their lines in order, all lines, texts joined by blanks, polygons as closed rings. A line without region stands among the lines only."""
    one = F.struct("box", G.close_ring(F.col("polygon")).alias("polygon"), F.coalesce("transcription", F.lit("")).alias("text"))
    rows = lines.select(page, region, order, one.alias("l"))
    texts = lambda ls: F.array_join(F.transform(ls, lambda x: x["text"]), " ")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "l"))), lambda r: F.struct(r["l"]["box"].alias("bbox"), r["l"]["polygon"].alias("polygon"), r["l"]["text"].alias("text")))
    regions = rows.where(F.col(region).isNotNull()).groupBy(page, region).agg(listed.alias("lines"), F.min(order).alias("first"), *(f(F.col("l.box")[i]).alias(n) for i, (f, n) in enumerate(((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2")))))
    box = F.array("x1", "y1", "x2", "y2")
    own = F.struct(box.alias("bbox"), G.close_ring(G.bbox_polygon(box)).alias("polygon"), "lines", texts(F.col("lines")).alias("text"))
    per_page = regions.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", own.alias("r")))), lambda r: r["r"]).alias("regions"))
    every = rows.groupBy(page).agg(listed.alias("lines"))
    return every.join(per_page, page, "left").select(F.coalesce("regions", F.array()).alias("regions"), "lines", texts(F.col("lines")).alias("text"), F.col(page).alias("path"))


def write_page_xml(pages: DataFrame, path: str, root: str = "PcGts") -> None:
    """Page elements as XML documents, one a partition with its pages under one root; line breaks within texts become references."""

    def document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [f"<{root}>"]})
        for batch in batches:
            yield batch
        yield pd.DataFrame({"value": [f"</{root}>"]})

    pages.select(F.regexp_replace("xml", "\n", "&#10;").alias("value")).mapInPandas(document, "value string").write.mode("overwrite").text(path)
