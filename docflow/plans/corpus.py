"""Queries of the general corpus problems: archives (4) and nested records (5)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.operators import archive, nested
from docflow.session import shared_dir
from docflow.sources.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose record an earlier file already holds: all records are packed, the container is written, and its copies are those with a place in its blocks."""
    return archive.packed_copies(_container(spark, sf_dir))


def _container(spark: SparkSession, sf_dir: str) -> archive.Container:
    return archive.write(archive.pack(table(spark, sf_dir, "label_files")), f"{shared_dir(spark)}/docflow/archive-{uuid.uuid4().hex}")


def p4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed containers without their payload, with the checksum of the block and the number of its entries."""
    blocks = archive.pack(table(spark, sf_dir, "label_files")).blocks
    return blocks.select("block_id", "n_files", "n_bytes", "crc32", F.size("file_ids").cast("long").alias("n_entries"))


def p4_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with the file that holds its record and the lengths of both, from the written container alone."""
    return archive.resolve(_container(spark, sf_dir)).select("file_id", "file_path", "stored_id", "length", "stored_length")


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bodies of the stored files, cut from the blocks' payloads, whose checksums hold."""
    return archive.restore(_container(spark, sf_dir).blocks).where("intact").select("file_id", "file_path", F.decode("bytes", "UTF-8").alias("body"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of every region, line and polygon point."""
    return nested.nodes(table(spark, sf_dir, "page_annotations"), values=False)


def p5_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.regions(nested.nodes(table(spark, sf_dir, "page_annotations")))


def p5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.lines(nested.nodes(table(spark, sf_dir, "page_annotations")))


def p5_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.points(nested.nodes(table(spark, sf_dir, "page_annotations")))


QUERIES = {f.__name__: f for f in (p4_found, p4_blocks, p4_resolve, p4_restored, p5_found, p5_regions, p5_lines, p5_points)}

_BOXES = r"""
WITH lines AS (
  SELECT file_id, nfc_normalize(unique_key) AS k,
         list_filter(string_split_regex(replace(body, chr(65279), ''), '[\r\n]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '') AS ls
  FROM label_files WHERE body IS NOT NULL),
boxes AS (
  SELECT file_id, k, list_sort(list_transform(ls, lambda x: list_transform(string_split(trim(regexp_replace(x, '\s+', ' ', 'g')), ' '), lambda t: CAST(t AS DOUBLE)))) AS b FROM lines),
firsts AS (SELECT file_id, min(file_id) OVER (PARTITION BY k, b) AS first_id FROM boxes)"""

# A page's regions, lines and polygons by recursion over JSON values; an object stands for an array of one.
_PAGES = """
WITH RECURSIVE stored AS (
  SELECT page_id, payload, row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC NULLS LAST, md5(payload) DESC NULLS LAST) AS k FROM page_annotations),
roots AS (SELECT page_id, CAST(payload AS JSON) AS root FROM stored WHERE k = 1 AND json_valid(payload)),
found AS (SELECT page_id, root, COALESCE(json_extract(root, '$.Page'), json_extract(root, '$.*.Page')[1], root) AS page FROM roots WHERE json_type(root) = 'OBJECT'),
pages AS (
  SELECT page_id, CASE json_type(page) WHEN 'ARRAY' THEN list_filter(json_extract(page, '$[*]'), lambda x: json_type(x) = 'OBJECT')[1] ELSE page END AS page FROM found),
tops AS (SELECT page_id, json_extract(page, '$.regions') AS r FROM pages),
top_items AS (SELECT page_id, CASE json_type(r) WHEN 'ARRAY' THEN json_extract(r, '$[*]') WHEN 'OBJECT' THEN [r] ELSE [] END AS items FROM tops),
walk AS (
  SELECT page_id, CAST(i AS VARCHAR) AS region_path, items[i + 1] AS node FROM (SELECT page_id, items, unnest(range(len(items))) AS i FROM top_items) WHERE json_type(items[i + 1]) = 'OBJECT'
  UNION ALL
  SELECT page_id, region_path || '.' || i, items[i + 1] FROM (
    SELECT page_id, region_path, items, unnest(range(len(items))) AS i FROM (
      SELECT page_id, region_path, CASE json_type(json_extract(node, '$.regions')) WHEN 'ARRAY' THEN json_extract(node, '$.regions[*]') WHEN 'OBJECT' THEN [json_extract(node, '$.regions')] ELSE [] END AS items FROM walk))
  WHERE json_type(items[i + 1]) = 'OBJECT'),
line_items AS (
  SELECT page_id, region_path, CASE json_type(json_extract(node, '$.lines')) WHEN 'ARRAY' THEN json_extract(node, '$.lines[*]') WHEN 'OBJECT' THEN [json_extract(node, '$.lines')] ELSE [] END AS items FROM walk),
line_nodes AS (
  SELECT page_id, region_path, i AS line_no, items[i + 1] AS node FROM (SELECT page_id, region_path, items, unnest(range(len(items))) AS i FROM line_items) WHERE json_type(items[i + 1]) = 'OBJECT'),
owners AS (SELECT page_id, region_path, -1 AS line_no, node FROM walk UNION ALL SELECT * FROM line_nodes),
polygons AS (
  SELECT page_id, region_path, line_no, CASE WHEN json_exists(node, '$.polygon.points') THEN json_extract(node, '$.polygon.points') ELSE json_extract(node, '$.polygon') END AS v FROM owners),
point_items AS (
  SELECT page_id, region_path, line_no, CASE json_type(v)
    WHEN 'ARRAY' THEN list_transform(json_extract(v, '$[*]'), lambda e: CASE WHEN json_type(e) IN ('ARRAY', 'OBJECT', 'VARCHAR') THEN e END)
    WHEN 'OBJECT' THEN CASE WHEN json_exists(v, '$.x') THEN [v] ELSE [] END
    WHEN 'VARCHAR' THEN list_transform(list_filter(string_split_regex(json_extract_string(v, '$'), '\\s+'), lambda e: e <> ''), lambda e: to_json(e)) ELSE [] END AS items FROM polygons),
point_nodes AS (SELECT page_id, region_path, line_no, i AS point_no, items[i + 1] AS v FROM (SELECT *, unnest(range(len(items))) AS i FROM point_items) WHERE items[i + 1] IS NOT NULL)"""

ORACLE = {
    "p5_found": _PAGES + """
SELECT page_id, region_path, CAST(-1 AS INT) AS line_no, CAST(-1 AS INT) AS point_no FROM walk
UNION ALL SELECT page_id, region_path, CAST(line_no AS INT), CAST(-1 AS INT) FROM line_nodes
UNION ALL SELECT page_id, region_path, CAST(line_no AS INT), CAST(point_no AS INT) FROM point_nodes""",
    "p5_regions": _PAGES + """
SELECT page_id, region_path, CASE WHEN region_path LIKE '%.%' THEN regexp_replace(region_path, '[.][0-9]+$', '') END AS parent_path,
  CASE json_type(json_extract(node, '$.region_id')) WHEN 'VARCHAR' THEN json_extract_string(node, '$.region_id') END AS region_id,
  CASE json_type(json_extract(node, '$.transcription')) WHEN 'VARCHAR' THEN json_extract_string(node, '$.transcription') END AS transcription FROM walk""",
    "p5_lines": _PAGES + """
SELECT page_id, region_path, CAST(line_no AS INT) AS line_no,
  CASE json_type(json_extract(node, '$.line_id')) WHEN 'VARCHAR' THEN json_extract_string(node, '$.line_id') END AS line_id,
  CASE json_type(json_extract(node, '$.transcription')) WHEN 'VARCHAR' THEN json_extract_string(node, '$.transcription') END AS transcription FROM line_nodes""",
    "p5_points": _PAGES + """
SELECT page_id, region_path, CAST(line_no AS INT) AS line_no, CAST(point_no AS INT) AS point_no,
  TRY_CAST(trim(CASE json_type(v) WHEN 'ARRAY' THEN json_extract_string(v, '$[0]') WHEN 'OBJECT' THEN json_extract_string(v, '$.x') ELSE split_part(json_extract_string(v, '$'), ',', 1) END) AS DOUBLE) AS x,
  TRY_CAST(trim(CASE json_type(v) WHEN 'ARRAY' THEN json_extract_string(v, '$[1]') WHEN 'OBJECT' THEN json_extract_string(v, '$.y') ELSE split_part(json_extract_string(v, '$'), ',', 2) END) AS DOUBLE) AS y FROM point_nodes""",
    "p4_found": _BOXES + " SELECT file_id FROM firsts WHERE first_id < file_id",
    "p4_resolve": _BOXES + """
SELECT f.file_id, f.file_path, first_id AS stored_id, CAST(strlen(f.body) AS BIGINT) AS length, CAST(strlen(s.body) AS BIGINT) AS stored_length
FROM firsts JOIN label_files f USING (file_id) JOIN label_files s ON s.file_id = first_id""",
    "p4_restored": _BOXES + " SELECT file_id, file_path, body FROM firsts JOIN label_files USING (file_id) WHERE first_id = file_id",
}
