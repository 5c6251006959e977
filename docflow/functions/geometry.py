"""Boxes and polygons as Spark columns. A box is an array (x1, y1, x2, y2), y downwards; a polygon an array of struct(x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("x1", "y1", "x2", "y2")


def corners(box: Column) -> list[Column]:
    return [F.get(box, F.lit(i)) for i in range(4)]


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(x1, y1, x2, y2)


def parse_points(points: Column) -> Column:
    """The polygon of a text "x,y x,y"; a coordinate that is no integer raises, as integers are required."""
    pairs = F.filter(F.split(F.trim(points), r"\s+"), lambda p: p != "")
    part = lambda p, i: F.split(p, ",").getItem(i).cast("int")
    return F.transform(pairs, lambda p: F.struct(part(p, 0).alias("x"), part(p, 1).alias("y")))


def format_points(polygon: Column) -> Column:
    return F.array_join(F.transform(polygon, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")


def polygon_bbox(polygon: Column) -> Column:
    """The box around a polygon."""
    side = lambda c: F.transform(polygon, lambda p: p[c])
    return F.array(F.array_min(side("x")), F.array_min(side("y")), F.array_max(side("x")), F.array_max(side("y")))


def bbox_polygon(b: Column) -> Column:
    """A box's corners: top left, bottom left, bottom right, top right."""
    x1, y1, x2, y2 = corners(b)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(x1, y1), point(x1, y2), point(x2, y2), point(x2, y1))


def to_xywh(b: Column) -> Column:
    x1, y1, x2, y2 = corners(b)
    return F.array(x1, y1, x2 - x1, y2 - y1)


def from_xywh(b: Column) -> Column:
    x, y, w, h = corners(b)
    return F.array(x, y, x + w, y + h)


def shift_box(b: Column, dx: Column, dy: Column) -> Column:
    x1, y1, x2, y2 = corners(b)
    return F.array(x1 + dx, y1 + dy, x2 + dx, y2 + dy)


def shift_polygon(polygon: Column, dx: Column, dy: Column) -> Column:
    return F.transform(polygon, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def close_ring(polygon: Column) -> Column:
    """The polygon with its first point again at the end."""
    return F.when(F.size(polygon) > 0, F.concat(polygon, F.slice(polygon, 1, 1))).otherwise(polygon)


def area(b: Column) -> Column:
    x1, y1, x2, y2 = (c.cast("long") for c in corners(b))
    return (x2 - x1) * (y2 - y1)


def intersection_area(a: Column, b: Column) -> Column:
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = ([c.cast("long") for c in corners(x)] for x in (a, b))
    zero = F.lit(0).cast("long")
    return F.greatest(zero, F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(zero, F.least(ay2, by2) - F.greatest(ay1, by1))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; null where both boxes are empty."""
    common = intersection_area(a, b)
    return F.try_divide(common.cast("double"), (area(a) + area(b) - common).cast("double"))


def coverage(small: Column, large: Column) -> Column:
    """The share of small that large covers; 0 for an empty small."""
    return F.when(area(small) == 0, F.lit(0.0)).otherwise(F.try_divide(intersection_area(small, large).cast("double"), area(small).cast("double")))


def merge(a: Column, b: Column) -> Column:
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = corners(a), corners(b)
    return F.array(F.least(ax1, bx1), F.least(ay1, by1), F.greatest(ax2, bx2), F.greatest(ay2, by2))


def clip(inner: Column, outer: Column) -> Column:
    """The part of a box inside another; the box itself where they share no area."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = corners(inner), corners(outer)
    return F.when(intersection_area(inner, outer) > 0, F.array(F.greatest(ax1, bx1), F.greatest(ay1, by1), F.least(ax2, bx2), F.least(ay2, by2))).otherwise(inner)


def yolo_box(b: Column, width: Column, height: Column) -> Column:
    """Centre and size as shares of the image: (xc, yc, w, h)."""
    x1, y1, x2, y2 = (c.cast("double") for c in corners(b))
    return F.array((x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height)


def yolo_polygon(polygon: Column, width: Column, height: Column) -> Column:
    """x, y, x, y ... as shares of the image."""
    return F.flatten(F.transform(polygon, lambda p: F.array(p["x"].cast("double") / width, p["y"].cast("double") / height)))


def pairs(flat: Column) -> Column:
    """A polygon from a flat array x, y, x, y ...; an odd last value is left out."""
    point = lambda i: F.struct(F.get(flat, i).alias("x"), F.get(flat, i + 1).alias("y"))
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(flat) - 2, F.lit(0)), F.lit(2)), lambda i: i + 1 < F.size(flat))
    return F.transform(places, point)


def decode_yolo(label: Column, width: Column, height: Column) -> Column:
    """struct(class_id, polygon) of a label line `cls x y x y ...`."""
    parts = F.split(F.trim(label), r"\s+")
    values = F.transform(F.slice(parts, 2, F.size(parts)), lambda v: v.cast("double"))
    scaled = F.transform(pairs(values), lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y")))
    return F.struct(parts[0].cast("int").alias("class_id"), scaled.alias("polygon"))


#: Bins of the location vocabulary a side (fixed value).
BINS = 1000


def quantise(value: Column, size: Column, bins: int = BINS) -> Column:
    """The bin of a coordinate, 0 to bins - 1."""
    return F.least(F.greatest(F.floor(value / (size.cast("double") / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")


def dequantise(value: Column, size: Column, bins: int = BINS) -> Column:
    """The middle of a bin as a coordinate."""
    return (value + F.lit(0.5)) * (size.cast("double") / bins)


def quantise_box(b: Column, width: Column, height: Column, bins: int = BINS) -> Column:
    return F.array(*(quantise(c, s, bins) for c, s in zip(corners(b), (width, height, width, height), strict=True)))


def dequantise_box(b: Column, width: Column, height: Column, bins: int = BINS) -> Column:
    return F.array(*(dequantise(c, s, bins) for c, s in zip(corners(b), (width, height, width, height), strict=True)))


def quantise_polygon(polygon: Column, width: Column, height: Column, bins: int = BINS) -> Column:
    return F.transform(polygon, lambda p: F.struct(quantise(p["x"], width, bins).alias("x"), quantise(p["y"], height, bins).alias("y")))


def dequantise_polygon(polygon: Column, width: Column, height: Column, bins: int = BINS) -> Column:
    return F.transform(polygon, lambda p: F.struct(dequantise(p["x"], width, bins).alias("x"), dequantise(p["y"], height, bins).alias("y")))


def location_tokens(values: Column) -> Column:
    """<loc_v> for each value, joined."""
    return F.array_join(F.transform(values, lambda v: F.concat(F.lit("<loc_"), v.cast("string"), F.lit(">"))), "")
