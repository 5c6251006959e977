"""Schemas of pages, regions and lines."""

from __future__ import annotations

from pyspark.sql import types as T

BBOX = T.ArrayType(T.IntegerType())
POINT = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])
POLYGON = T.ArrayType(POINT)
LINE = T.StructType([T.StructField("bbox", BBOX), T.StructField("polygon", POLYGON), T.StructField("text", T.StringType())])
REGION = T.StructType([T.StructField("bbox", BBOX), T.StructField("polygon", POLYGON), T.StructField("lines", T.ArrayType(LINE)), T.StructField("text", T.StringType())])
PAGE = T.StructType([T.StructField("regions", T.ArrayType(REGION)), T.StructField("lines", T.ArrayType(LINE)), T.StructField("text", T.StringType()), T.StructField("path", T.StringType())])
RATIO = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
