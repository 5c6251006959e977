"""The seven dataset variants, as views over one table of lines.

lines: volume, page, region_id, position (order in the page), box, polygon, transcription. Pixels aren't cut here: a row names its page and the
polygon or box to crop, which operators.crops applies to image bytes. Rows that lack what a variant needs are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.functions import geometry as G
from docflow.operators import layout, records


def _recognition(lines: DataFrame, shape: str) -> DataFrame:
    """A row a line with text, numbered before lines without text are dropped."""
    named = lines.withColumn("page_key", F.concat_ws("_", "volume", "page"))
    kept = records.gapped_keys(named.where("polygon is not null"), F.col("transcription") != "", "page_key", ["position"])
    crop = F.col("polygon") if shape == "polygon" else G.bbox_polygon(G.polygon_bbox(F.col("polygon")))
    return kept.select("unique_key", F.col("page").alias("img_filename"), crop.alias("crop"), "transcription")


def _regions(lines: DataFrame) -> DataFrame:
    cover = layout.cover_bbox(lines.where("region_id is not null"), ["page", "region_id"])
    first = lines.where("region_id is not null").groupBy("page", "region_id").agg(F.min("position").alias("position"))
    return cover.join(first, ["page", "region_id"])


def _within_regions(lines: DataFrame, with_text: bool) -> DataFrame:
    """A row a region with its lines clipped to it and moved to its origin."""
    regions = _regions(lines)
    keyed = records.dense_keys(regions.withColumnRenamed("position", "first"), "page", ["first", "region_id"]).select("page", "region_id", "cover", "unique_key")
    inside = lines.where("region_id is not null and polygon is not null").join(keyed, ["page", "region_id"])
    inside = inside.withColumn("box", G.clip(G.polygon_bbox(F.col("polygon")), F.col("cover")))
    rows = records.annotations_in_regions(inside.withColumn("transcription", F.coalesce("transcription", F.lit(""))), "page", "region_id", with_text)
    return keyed.join(rows, ["page", "region_id"]).select("unique_key", F.col("page").alias("img_filename"), G.bbox_polygon(F.col("cover")).alias("crop"), "annotations")


def _on_pages(lines: DataFrame, with_regions: bool, with_lines: bool) -> DataFrame:
    regions = _regions(lines).select("page", "position", G.bbox_polygon(F.col("cover")).alias("polygon"), F.lit("").alias("transcription"))
    whole = lines.where("polygon is not null").select("page", "position", "polygon", F.coalesce("transcription", F.lit("")).alias("transcription"))
    rows = records.annotations_by_page(whole if with_lines else whole.where("false"), regions if with_regions else regions.where("false"), "page")
    return rows.select(F.col("page").alias("unique_key"), F.col("page").alias("img_filename"), "annotations")


VARIANTS = {
    "text_recognition__line_seg": lambda lines: _recognition(lines, "polygon"),
    "text_recognition__line_bbox": lambda lines: _recognition(lines, "box"),
    "inst_seg_lines_within_regions": lambda lines: _within_regions(lines, True),
    "line_od_within_regions": lambda lines: _within_regions(lines, False),
    "inst_seg_regions_and_lines": lambda lines: _on_pages(lines, True, True),
    "inst_seg_lines": lambda lines: _on_pages(lines, False, True),
    "inst_seg_regions": lambda lines: _on_pages(lines, True, False),
}


def build(name: str, lines: DataFrame) -> DataFrame:
    if name not in VARIANTS:
        raise ValueError(f"{name} is none of {', '.join(VARIANTS)}")
    return VARIANTS[name](lines)
