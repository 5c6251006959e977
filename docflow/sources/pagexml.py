"""PAGE-XML pages as tables of regions and lines, through Spark's XML reader with a fixed schema.

Empty Unicode is kept as ''. A line without TextEquiv or Coords is dropped, a region without them too, though its lines
stay. Regions within regions are read to any depth: the schema holds `depth` levels (counted from the files where it is
None), and a deeper region raises an error rather than vanishing. A line counts for the region that holds it. Files that
aren't XML give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.functions import geometry as G
from docflow.operators.records import dense_keys, stem, volume

#: Levels of regions within regions that the schema holds unless another number is given.
DEPTH = 4
_TEXT = T.ArrayType(T.StructType([T.StructField("Unicode", T.StringType())]))
_COORDS = T.StructType([T.StructField("_points", T.StringType())])
_LINE = T.StructType([T.StructField("_id", T.StringType()), T.StructField("Coords", _COORDS), T.StructField("TextEquiv", _TEXT)])


def _region(depth: int) -> T.StructType:
    fields = [T.StructField("_id", T.StringType()), T.StructField("Coords", _COORDS), T.StructField("TextLine", T.ArrayType(_LINE)), T.StructField("TextEquiv", _TEXT)]
    inner = _region(depth - 1) if depth > 1 else T.StringType()
    return T.StructType([*fields, T.StructField("TextRegion", T.ArrayType(inner))])


def nesting(spark: SparkSession, path: str) -> int:
    """The deepest nesting of regions in the files below path, by their tags."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.regexp_replace("value", r"<(\w+:)?TextRegion\b[^>]*/>", "<TextRegion></TextRegion>").alias("value"))
    tags = F.regexp_extract_all("value", F.lit(r"<(/?)(?:\w+:)?TextRegion\b"), F.lit(1))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = F.when(F.lit(True), F.lit(1))
    deepest = F.aggregate(tags, zero, lambda z, t: F.struct((z["now"] + F.when(t == "", step).otherwise(-1)).alias("now"), F.greatest(z["most"], z["now"] + F.when(t == "", step).otherwise(-1)).alias("most")))
    return text.agg(F.max(deepest["most"])).first()[0] or 1


def read_xml(spark: SparkSession, path: str, depth: int | None = DEPTH) -> DataFrame:
    """path, volume, img_filename and the Page element of every page of the files below path."""
    depth = depth or nesting(spark, path)
    schema = T.StructType([T.StructField("_imageFilename", T.StringType()), T.StructField("TextRegion", T.ArrayType(_region(depth)))])
    reader = spark.read.format("xml").schema(schema).option("rowTag", "Page").option("mode", "PERMISSIVE").option("nullValue", "\x00").option("recursiveFileLookup", "true")
    raw, file = reader.load(path).where("_imageFilename is not null or TextRegion is not null"), F.col("_metadata.file_path")
    name = F.coalesce(stem(F.col("_imageFilename")), stem(file))
    return raw.select(file.alias("path"), volume(file).alias("volume"), name.alias("img_filename"), F.col("TextRegion").alias("regions"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, line_id, text of every line of the files below path: all text within its element, of words and readings too, without white space around it."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"(?s)<!--.*?-->|<(\w+:)?TextLine\b[^>]*/>", "").alias("value"))
    lines = files.select("path", F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<(?:\w+:)?TextLine\b.*?</(?:\w+:)?TextLine>)"), F.lit(1))).alias("x"))
    text = F.regexp_replace("x", "(?s)<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#10;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return lines.select("path", F.regexp_extract("x", r'^<[^>]*?\bid="([^"]*)"', 1).alias("line_id"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))


def _text(equiv: Column) -> Column:
    """The first Unicode, '' if it is empty, null without a TextEquiv."""
    return F.when(F.size(equiv) > 0, F.coalesce(F.get(equiv, F.lit(0))["Unicode"], F.lit("")))


def _all_regions(pages: DataFrame) -> DataFrame:
    """Every region with its place: array of positions from the page down, so depth first order is the order of places."""
    level = pages.select("path", "volume", "img_filename", F.posexplode("regions").alias("n", "r")).select("path", "volume", "img_filename", F.array("n").alias("place"), "r")
    found = None
    kind = pages.schema["regions"].dataType
    while True:
        inner = kind.elementType["TextRegion"].dataType
        last = not isinstance(inner.elementType, T.StructType)
        if last:  # a region within would be lost
            deeper = F.raise_error(F.concat(F.lit("regions nested deeper than the depth read, in "), "path")).cast("boolean")
            level = level.where(F.when(F.size("r.TextRegion") > 0, deeper).otherwise(True))
        flat = level.select("path", "volume", "img_filename", "place", F.col("r._id").alias("region_id"), F.col("r.Coords._points").alias("points"), _text(F.col("r.TextEquiv")).alias("transcription"), F.col("r.TextLine").alias("lines"))
        found = flat if found is None else found.unionByName(flat)
        if last:
            return found
        kind, level = inner, level.select("path", "volume", "img_filename", "place", F.posexplode("r.TextRegion").alias("n", "r")).select("path", "volume", "img_filename", F.concat("place", F.array("n")).alias("place"), "r")


def _shaped(rows: DataFrame) -> DataFrame:
    """polygon and bbox of points; rows with a point that isn't two integers are dropped."""
    good = F.col("points").rlike(r"^\s*-?\d+,-?\d+(\s+-?\d+,-?\d+)*\s*$")
    polygon = G.parse_points(F.when(good, F.col("points")))
    return rows.where(good).withColumn("polygon", polygon).withColumn("bbox", G.polygon_bbox(F.col("polygon"))).drop("points")


def regions(pages: DataFrame) -> DataFrame:
    """region_id, bbox, polygon, transcription, lines of each whole region, with keys that number the regions that are left."""
    whole = _shaped(_all_regions(pages)).where("transcription is not null")
    return dense_keys(whole, "img_filename", ["place"])


def lines(pages: DataFrame) -> DataFrame:
    """region_id, line_id, bbox, polygon, transcription of each whole line, also of dropped regions, with dense keys."""
    each = _all_regions(pages).select("path", "volume", "img_filename", "place", "region_id", F.posexplode("lines").alias("n", "l"))
    flat = each.select("path", "volume", "img_filename", "place", "n", "region_id", F.col("l._id").alias("line_id"), F.col("l.Coords._points").alias("points"), _text(F.col("l.TextEquiv")).alias("transcription"))
    return dense_keys(_shaped(flat).where("transcription is not null"), "img_filename", ["place", "n"])


def regions_with_lines(pages: DataFrame) -> DataFrame:
    """Every region with its whole lines; a region that isn't whole has only these."""
    every = _all_regions(pages).select("img_filename", "place")
    own = regions(pages).select("img_filename", "place", "region_id", "bbox", "polygon", "transcription")
    of = lines(pages).groupBy("img_filename", "place").agg(F.array_sort(F.collect_list(F.struct("n", "line_id", "bbox", "polygon", "transcription"))).alias("lines"))
    return every.join(own, ["img_filename", "place"], "left").join(of, ["img_filename", "place"], "left")


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """Paths of files below path that hold no page."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("_metadata.file_path").alias("path"))
    return files.join(read_xml(spark, path).select("path").distinct(), "path", "left_anti")
