"""Keys, pairings, views and training records of the document model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import geometry as G
from docflow.session import materialise

#: Image suffixes that a scan takes, as spelled (fixed values).
IMAGE_SUFFIXES = (
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff",
    ".JPG", ".JPEG", ".PNG", ".GIF", ".BMP", ".TIF", ".TIFF",
)
#: Classes of annotations (fixed values).
LINE_CLASS, REGION_CLASS, BOX_CLASS = "textline", "textregion", "line_bbox"
#: Task prompts of the vision-language model (fixed values).
TASKS = {
    "od": "<OD>",
    "dense_region_caption": "<DENSE_REGION_CAPTION>",
    "caption": "<CAPTION>",
    "detailed_caption": "<DETAILED_CAPTION>",
    "more_detailed_caption": "<MORE_DETAILED_CAPTION>",
    "region_proposal": "<REGION_PROPOSAL>",
    "phrase_grounding": "<CAPTION_TO_PHRASE_GROUNDING>",
    "expression_segmentation": "<REFERRING_EXPRESSION_SEGMENTATION>",
    "region_to_segmentation": "<REGION_TO_SEGMENTATION>",
    "open_vocabulary": "<OPEN_VOCABULARY_DETECTION>",
    "region_to_description": "<REGION_TO_DESCRIPTION>",
    "ocr": "<OCR>",
    "ocr_with_region": "<OCR_WITH_REGION>",
}


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def volume(path: Column) -> Column:
    """The name of the folder that holds the file."""
    return F.element_at(F.split(path, "/"), -2)


def dense_keys(rows: DataFrame, page: str, order: list[str]) -> DataFrame:
    """unique_key: page, underscore, four-digit number of the row among those that are left."""
    at = F.row_number().over(Window.partitionBy(page).orderBy(*order)) - 1
    return rows.withColumn("unique_key", F.concat_ws("_", F.col(page), F.format_string("%04d", at)))


def gapped_keys(rows: DataFrame, keep: Column, page: str, order: list[str]) -> DataFrame:
    """As dense_keys, but numbered before rows that fail keep are dropped, so their numbers stay free."""
    return dense_keys(rows, page, order).where(keep)


def pairing_report(images: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """One row: images, annotations, pairs by key, and whether all three agree and are more than none."""
    both = images.select(key).distinct().withColumn("i", F.lit(1)).join(annotations.select(key).distinct().withColumn("a", F.lit(1)), key, "full")
    counts = both.agg(F.count("i").alias("n_images"), F.count("a").alias("n_annotations"), F.count_if(F.col("i").isNotNull() & F.col("a").isNotNull()).alias("n_pairs"))
    return counts.withColumn("complete", (F.col("n_pairs") > 0) & (F.col("n_images") == F.col("n_pairs")) & (F.col("n_annotations") == F.col("n_pairs")))


def pair(images: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Images with their annotations, by key."""
    return images.join(annotations, key)


def unprocessed(pages: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Pages without an output yet."""
    return pages.join(done.select(key).distinct(), key, "left_anti")


def cached_or(pages: DataFrame, cached: DataFrame, computed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each page's stored metrics where there are any, else the computed ones."""
    old = cached.select(key, *(F.col(c).alias(f"_old_{c}") for c in columns), F.lit(True).alias("cached"))
    both = pages.select(key).join(computed, key, "left").join(old, key, "left")
    return both.select(key, *(F.coalesce(f"_old_{c}", c).alias(c) for c in columns), F.coalesce("cached", F.lit(False)).alias("cached"))


def side_by_side(frames: list[DataFrame], key: str) -> DataFrame:
    """Metric tables of the same key joined column by column, null where one lacks the key."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.join(frame, key, "full")
    return out


def in_crop(rows: DataFrame, parent: str) -> DataFrame:
    """box and polygon moved to the origin of the parent box."""
    x, y, _, _ = G.corners(F.col(parent))
    return rows.withColumns({"box": G.shift_box(F.col("box"), -x, -y), "polygon": G.shift_polygon(F.col("polygon"), -x, -y)})


def on_page(rows: DataFrame, parent: str) -> DataFrame:
    """box and polygon moved back from the parent box's origin."""
    x, y, _, _ = G.corners(F.col(parent))
    return rows.withColumns({"box": G.shift_box(F.col("box"), x, y), "polygon": G.shift_polygon(F.col("polygon"), x, y)})


def annotations_by_page(lines: DataFrame, regions: DataFrame, page: str) -> DataFrame:
    """annotations of each page: its regions, then its lines, in order. lines, regions: page, position, polygon, transcription."""
    of = lambda rows, kind, rank: rows.select(page, F.struct(F.lit(rank).alias("r"), F.col("position").cast("long").alias("i"), F.struct(F.col("polygon"), (F.lit("") if kind == REGION_CLASS else F.col("transcription")).alias("transcription"), F.lit(kind).alias("class")).alias("a")).alias("s"))
    every = of(regions, REGION_CLASS, 0).unionByName(of(lines, LINE_CLASS, 1))
    return every.groupBy(page).agg(F.transform(F.array_sort(F.collect_list("s"), lambda x, y: F.when(x["r"] != y["r"], x["r"] - y["r"]).when(x["i"] < y["i"], -1).when(x["i"] > y["i"], 1).otherwise(0)), lambda s: s["a"]).alias("annotations"))


def annotations_in_regions(lines: DataFrame, page: str, region: str, with_text: bool) -> DataFrame:
    """annotations of each region's lines in its crop: polygons with text, or boxes. lines: page, region, cover, position, box, polygon, transcription."""
    moved = in_crop(lines, "cover")
    one = F.struct("polygon", "transcription", F.lit(LINE_CLASS).alias("class")) if with_text else F.struct("box", F.lit(BOX_CLASS).alias("class"))
    rows = moved.groupBy(page, region).agg(F.array_sort(F.collect_list(F.struct("position", one.alias("a")))).alias("rows"))
    return rows.select(page, region, F.transform("rows", lambda r: r["a"]).alias("annotations"))


def detection_answers(lines: DataFrame, group: list[str], order: str, width: Column, height: Column, kind: str = BOX_CLASS) -> DataFrame:
    """answer: for each box of a group in order its class and four location tokens, joined."""
    tokens = F.concat(F.lit(kind), G.location_tokens(G.quantise_box(F.col("box"), width, height)))
    rows = lines.select(*group, order, tokens.alias("t")).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, "t"))).alias("rows"))
    return rows.select(*group, F.array_join(F.transform("rows", lambda r: r["t"]), "").alias("answer"))


def prompt(task: Column, user: Column) -> Column:
    """The model's prompt: the task followed by the user's text, if any."""
    return F.concat(task, F.coalesce(user, F.lit("")))


def strip_padding(text: Column) -> Column:
    return F.replace(text, F.lit("<pad>"), F.lit(""))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """index of each row in the order, an int, and _total."""
    return positions(rows, order).withColumn("index", F.col("index").cast("int"))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """index of each row in the order, a bigint, and _total. Rows are cut into ranges and numbered within them, so no task sees all."""
    ranged = materialise(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # A row a partition.
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    found = ranged.withColumn("_local", local).join(F.broadcast(before), "_range")
    return found.withColumn("index", (F.col("_before") + F.col("_local")).cast("long")).drop("_range", "_local", "_before")


def select_rows(rows: DataFrame, order: list[str], start: int | None = None, stop: int | None = None, step: int | None = None) -> DataFrame:
    """Rows start, start + step ... below stop of the order; without stop the last row is left out, as counted from the end by -1."""
    low, high, by = start or 0, -1 if stop is None else stop, step or 1
    end = F.lit(high) if high >= 0 else F.col("_total") + high
    return numbered(rows, order).where((F.col("index") >= low) & (F.col("index") < end) & ((F.col("index") - low) % by == 0)).drop("_total")


def batches(rows: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """batch: number of the batch of `size` rows within the group."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(at / size).cast("int"))


def best_checkpoint(checkpoints: DataFrame, model: str, step: str, metric: str) -> DataFrame:
    """The step of the least metric of each model, the first of equal ones; null metrics never win, and without any the last step stands."""
    return checkpoints.groupBy(model).agg(F.coalesce(F.min(F.when(F.col(metric).isNotNull(), F.struct(metric, step)))[step], F.max(step)).alias(step))


def last_checkpoint(checkpoints: DataFrame, model: str, step: str) -> DataFrame:
    return checkpoints.groupBy(model).agg(F.max(step).alias(step))


def running_mean(rows: DataFrame, model: str, step: str, metric: str) -> DataFrame:
    """Mean of the metric over all steps so far."""
    return rows.withColumn("running", F.avg(metric).over(Window.partitionBy(model).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)))


def validation_mean(rows: DataFrame, model: str, metric: str) -> DataFrame:
    """Sum of the metric over the number of rows, failed (null) ones included."""
    return rows.groupBy(model).agg((F.coalesce(F.sum(metric), F.lit(0.0)) / F.count("*")).alias("mean_loss"))


def linear_rate(base: Column | float, step: Column, total: Column | int) -> Column:
    """A learning rate that falls linearly to 0."""
    lift = lambda x: F.lit(x) if isinstance(x, (int, float)) else x
    return lift(base) * (1 - step.cast("double") / lift(total))
