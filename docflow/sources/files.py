"""Reads of files: listings, JSON, text, images and directories of tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docflow.operators.records import IMAGE_SUFFIXES, stem, suffix, volume
from docflow.schema import PAGE


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """path, length, modificationTime of all files below path whose suffix is listed, spelled as listed. No content is read.

    Names that begin with _ or ., which scans pass over, are listed too. Sorted by path; the sort is a range exchange of paths only.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    files = files.where(suffix(F.col("path")).isin(*suffixes))
    hidden = [f for f in _hidden_files(spark, path) if os.path.splitext(f[0].rsplit("/", 1)[-1])[1] in suffixes]
    if hidden:
        more = spark.createDataFrame(hidden, "path string, length long, ms long").select("path", "length", F.timestamp_millis("ms").alias("modificationTime"))
        files = files.union(more).dropDuplicates(["path"])  # scans do list some of these names, as _metadata
    return files.orderBy("path")


def _hidden_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """path, length and milliseconds of the files below path whose name, or a folder's on the way, begins with _ or a dot. Other files stay in the JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs, found, level = at(path).getFileSystem(spark._jsc.hadoopConfiguration()), [], path.rstrip("/")
    while level == path.rstrip("/") or fs.globStatus(at(level)):
        for entry in fs.globStatus(at(f"{level}/[_.]*")) or []:
            below = fs.listFiles(entry.getPath(), True)  # of a file, itself
            while below.hasNext():
                f = below.next()
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        level += "/[^_.]*"
    return found


def list_tables(spark: SparkSession, folder: str, kind: str = ".parquet") -> DataFrame:
    """stem of every table of a folder: its entries with the suffix, each a file or a folder of such files, once."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    entry = F.substring_index(F.expr(f"substring(path, {len(root) + 2})"), "/", 1)
    return list_files(spark, folder, (kind,)).select(entry.alias("entry")).where(F.endswith("entry", F.lit(kind))).select(stem(F.col("entry")).alias("stem")).distinct()


def read_images(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """volume, img_filename, path and bytes of every image below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(suffix(F.col("path")).isin(*suffixes)).select(volume(F.col("path")).alias("volume"), stem(F.col("path")).alias("img_filename"), "path", F.col("content").alias("image"))


def read_ndjson(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one JSON value each."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Pages as written by sinks.write_pages."""
    return spark.read.schema(PAGE).option("multiLine", str(multi_line).lower()).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Each line without white space around it, with its file."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Each file's whole text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_tables(spark: SparkSession, parent: str, schema: StructType | str | None = None, skip_corrupt: bool = False) -> DataFrame:
    """The union of the parquet tables in the folders of parent. An unreadable file is an error unless skip_corrupt; corrupt_tables() lists such files."""
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", str(skip_corrupt).lower()).option("mergeSchema", "true")
    return (reader.schema(schema) if schema else reader).parquet(parent)


def unite(frames: list[DataFrame]) -> DataFrame:
    """All rows of several tables by column name; a column that a table lacks is null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def corrupt_tables(spark: SparkSession, parent: str) -> DataFrame:
    """path, length of the parquet files below parent without a parquet file's marks at begin and end. Each file's content is read whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(parent)
    mark = F.lit(b"PAR1")
    return files.where((F.substring("content", 1, 4) != mark) | (F.substring("content", -4, 4) != mark)).select("path", "length")
