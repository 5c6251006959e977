"""Queries over the driver's tables for every operator of the document model, with their SQL.

text_lines stands for annotated lines (bbox, polygon, transcription); detections are its boxes moved by
(line_pk % 40, line_pk % 24) and read texts are its transcriptions with two letter pairs changed, in both engines. As the
SQL engine's levenshtein compares bytes, its texts are first recoded to a byte for each different code point.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions import geometry as G
from docflow.functions import ratios as R
from docflow.operators import layout, metrics, records, splits
from docflow.session import shared_dir, spread
from docflow.sources import files, pagexml, sinks
from docflow.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Size of a page image in pixels.
WIDTH, HEIGHT = 1800, 2400


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_pk, page, volume, region_id, line_id, key, box, polygon, transcription."""
    t = table(spark, sf_dir, "text_lines")
    lines = t.select("line_pk", F.col("img_filename").alias("page"), F.col("img_volume").alias("volume"), "region_id", "line_id", F.col("unique_key").alias("key"), F.col("bbox").alias("box"), "polygon", "transcription")
    return spread(lines, "page")


def _read(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("an"), F.lit("a")), F.lit("er"), F.lit("or"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with truth and read text."""
    lines = _lines(spark, sf_dir).where("transcription is not null")
    return lines.withColumns({"truth": F.col("transcription"), "read": _read(F.col("transcription"))})


def _detections(lines: DataFrame) -> DataFrame:
    dx, dy = (F.col("line_pk") % 40).cast("int"), (F.col("line_pk") % 24).cast("int")
    return lines.withColumn("box", G.shift_box(F.col("box"), dx, dy))


def _round(c: Column | str, digits: int = 9) -> Column:
    return F.round(c, digits)


_TEXTS = r"""t AS (SELECT line_pk, img_filename AS page, img_volume AS volume, unique_key AS key, transcription AS truth,
  replace(replace(transcription, 'an', 'a'), 'er', 'or') AS read FROM text_lines WHERE transcription IS NOT NULL)"""
_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_WORDS = _TEXTS + rf""", w AS (SELECT *, list_filter(string_split_regex(truth, '{_SPACES}'), lambda x: x <> '') AS tw, list_filter(string_split_regex(read, '{_SPACES}'), lambda x: x <> '') AS rw FROM t)"""


def _distance(a: str, b: str) -> str:
    """SQL of the edit distance in code points of two texts with at most 127 different ones."""
    signs = f"list_distinct(list_concat(string_split({a}, ''), string_split({b}, '')))"
    recoded = [f"array_to_string(list_transform(string_split({x}, ''), lambda c: chr(CAST(list_position({signs}, c) AS INT))), '')" for x in (a, b)]
    return f"levenshtein({recoded[0]}, {recoded[1]})"


_BOXES = """b AS (SELECT line_pk, img_filename AS page, region_id, bbox[1] AS x1, bbox[2] AS y1, bbox[3] AS x2, bbox[4] AS y2 FROM text_lines),
d AS (SELECT line_pk, page, CAST(x1 + line_pk % 40 AS INT) AS x1, CAST(y1 + line_pk % 24 AS INT) AS y1, CAST(x2 + line_pk % 40 AS INT) AS x2, CAST(y2 + line_pk % 24 AS INT) AS y2 FROM b)"""

# --- transcription metrics -------------------------------------------------------------------------------------------


@query(f"""WITH {_TEXTS}, e AS (SELECT volume, {_distance("truth", "read")} AS e, length(truth) AS n FROM t)
SELECT volume, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS characters, round(CASE WHEN sum(n) = 0 THEN 0.0 ELSE CAST(sum(e) AS DOUBLE) / sum(n) END, 9) AS cer FROM e GROUP BY volume""")
def cer_by_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: micro-averaged character error rate of each volume (A1, M1)."""
    scored = _texts(spark, sf_dir).groupBy("volume").agg(R.total(R.cer(F.col("truth"), F.col("read"))).alias("m"))
    return scored.select("volume", F.col("m.a").alias("errors"), F.col("m.b").alias("characters"), _round(R.value(F.col("m"))).alias("cer"))


@query(f"""WITH {_WORDS}, v AS (SELECT *, list_distinct(list_concat(tw, rw)) AS voc FROM w),
c AS (SELECT volume, len(tw) AS n, levenshtein(array_to_string(list_transform(tw, lambda x: chr(CAST(list_position(voc, x) AS INT))), ''), array_to_string(list_transform(rw, lambda x: chr(CAST(list_position(voc, x) AS INT))), '')) AS e FROM v)
SELECT volume, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS words FROM c GROUP BY volume""")
def wer_by_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word errors (M1): levenshtein over words recoded to code points."""
    scored = _texts(spark, sf_dir).groupBy("volume").agg(R.total(R.wer(F.col("truth"), F.col("read"))).alias("m"))
    return scored.select("volume", F.col("m.a").alias("errors"), F.col("m.b").alias("words"))


@query(f"""WITH {_WORDS}, h AS (SELECT volume, len(tw) AS n, len(rw) AS m,
coalesce(list_sum(list_transform(list_distinct(tw), lambda x: least(len(list_filter(tw, lambda y: y = x)), len(list_filter(rw, lambda y: y = x))))), 0) AS hits FROM w)
SELECT volume, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS words, CAST(sum(m - hits) AS BIGINT) AS extras, CAST(sum(m) AS BIGINT) AS words_read FROM h GROUP BY volume""")
def bow_by_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag-of-words hits and extras as multisets (M1)."""
    hits, extras = R.bag_of_words(F.col("truth"), F.col("read"))
    scored = _texts(spark, sf_dir).groupBy("volume").agg(R.total(hits).alias("h"), R.total(extras).alias("e"))
    return scored.select("volume", F.col("h.a").alias("hits"), F.col("h.b").alias("words"), F.col("e.a").alias("extras"), F.col("e.b").alias("words_read"))


@query(f"""WITH t AS (SELECT img_volume AS volume, coalesce(transcription, '') AS truth, CASE WHEN line_pk % 7 = 0 THEN '' ELSE coalesce(replace(replace(transcription, 'an', 'a'), 'er', 'or'), '') END AS read FROM text_lines),
m AS (SELECT volume, CASE WHEN truth = '' AND read = '' THEN 0 WHEN truth = '' OR read = '' THEN greatest(length(truth), length(read)) ELSE {_distance("read", "truth")} END AS a,
CASE WHEN truth = '' AND read = '' THEN 0 WHEN truth = '' OR read = '' THEN greatest(length(truth), length(read)) ELSE length(read) END AS b FROM t)
SELECT volume, CAST(sum(a) AS BIGINT) AS cer_a, CAST(sum(b) AS BIGINT) AS cer_b FROM m GROUP BY volume""")
def line_edge_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line metrics with the rules for empty lines, divided by the read text (M2)."""
    lines = _lines(spark, sf_dir)
    read = F.when(F.col("line_pk") % 7 == 0, "").otherwise(F.coalesce(_read(F.col("transcription")), F.lit("")))
    scored = metrics.score_lines(lines, ["volume"], F.coalesce(F.col("transcription"), F.lit("")), read)
    return scored.select("volume", F.col("cer.a").alias("cer_a"), F.col("cer.b").alias("cer_b"))


@query("""SELECT img_filename AS page, string_agg(transcription, ' ' ORDER BY unique_key, line_pk) AS text FROM text_lines WHERE transcription IS NOT NULL GROUP BY img_filename""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each page joined in order."""
    lines = _lines(spark, sf_dir).where("transcription is not null")
    return metrics.text_of(lines, ["page"], ["key", "line_pk"], "transcription").withColumnRenamed("transcription", "text")


@query(f"""WITH {_TEXTS}, p AS (SELECT page, string_agg(truth, ' ' ORDER BY key, line_pk) AS truth, string_agg(read, ' ' ORDER BY key, line_pk) AS read FROM t GROUP BY page),
e AS (SELECT page, truth, read, {_distance("truth", "read")} AS e, length(truth) AS n FROM p)
SELECT page, read AS hypothesis, truth AS reference, concat(e, '/', n) AS cer_str, round(CASE WHEN n = 0 THEN 0.0 ELSE CAST(e AS DOUBLE) / n END, 4) AS cer_float FROM e""")
def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character errors of whole pages, written with both texts as a fraction and a value and read back."""
    path = _fresh(spark, "metrics")
    scored = metrics.texts_of(_texts(spark, sf_dir), ["page"], ["key", "line_pk"], "truth", "read").select("page", F.col("read").alias("hypothesis"), F.col("truth").alias("reference"), R.ocr_metrics(F.col("truth"), F.col("read")).alias("m"))
    sinks.write_page_metrics(scored.select("page", "hypothesis", "reference", "m.*"), path)
    return spark.read.parquet(path).select("page", "hypothesis", "reference", "cer_str", "cer_float").withColumn("cer_float", _round(F.col("cer_float"), 4))


@query(f"""WITH {_TEXTS}, p AS (SELECT volume, {_distance("truth", "read")} AS a, length(truth) AS b FROM t)
SELECT volume, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b FROM p GROUP BY volume""")
def metrics_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored fractions parsed and summed again."""
    stored = _texts(spark, sf_dir).select("volume", R.fraction(R.cer(F.col("truth"), F.col("read"))).alias("cer"))
    total = stored.groupBy("volume").agg(R.total(R.parse(F.col("cer"))).alias("m"))
    return total.select("volume", F.col("m.a").alias("a"), F.col("m.b").alias("b"))


# --- boxes and polygons ----------------------------------------------------------------------------------------------


@query(f"""WITH {_BOXES}, p AS (SELECT b.line_pk, b.x1, b.y1, b.x2, b.y2, d.x1 AS u1, d.y1 AS v1, d.x2 AS u2, d.y2 AS v2,
CAST(greatest(0, least(b.x2, d.x2) - greatest(b.x1, d.x1)) AS BIGINT) * greatest(0, least(b.y2, d.y2) - greatest(b.y1, d.y1)) AS i,
CAST(b.x2 - b.x1 AS BIGINT) * (b.y2 - b.y1) AS a, CAST(d.x2 - d.x1 AS BIGINT) * (d.y2 - d.y1) AS c FROM b JOIN d USING (line_pk))
SELECT line_pk, round(CASE WHEN a + c - i = 0 THEN NULL ELSE CAST(i AS DOUBLE) / (a + c - i) END, 9) AS iou, round(CASE WHEN a = 0 THEN 0.0 ELSE CAST(i AS DOUBLE) / a END, 9) AS coverage,
least(x1, u1) AS mx1, least(y1, v1) AS my1, greatest(x2, u2) AS mx2, greatest(y2, v2) AS my2 FROM p""")
def box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU, coverage and merged box of each line and its detection."""
    lines = _lines(spark, sf_dir).select("line_pk", "box")
    both = _detections(lines.withColumn("a", F.col("box")))
    a, b = F.col("a"), F.col("box")
    merged = G.corners(G.merge(a, b))
    return both.select("line_pk", _round(G.iou(a, b)).alias("iou"), _round(G.coverage(a, b)).alias("coverage"), *(c.alias(n) for c, n in zip(merged, ("mx1", "my1", "mx2", "my2"), strict=True)))


_HIT = "greatest(0, least(a.x2, z.x2) - greatest(a.x1, z.x1)) * greatest(0, least(a.y2, z.y2) - greatest(a.y1, z.y1))"
_MET = f"EXISTS (SELECT 1 FROM {{}} z WHERE z.page = a.page AND 2 * ({_HIT}) >= (a.x2 - a.x1) * (a.y2 - a.y1) + (z.x2 - z.x1) * (z.y2 - z.y1) - ({_HIT}))"


@query(f"""WITH {_BOXES}, n AS (SELECT count(*) AS n_annotations, count_if({_MET.format("d")}) AS n_found FROM b a),
k AS (SELECT count(*) AS n_detections, count_if({_MET.format("b")}) AS n_correct FROM d a),
r AS (SELECT *, CASE WHEN n_found > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS rp, n_found::DOUBLE / n_annotations AS rec, n_correct::DOUBLE / n_detections AS pre FROM n, k)
SELECT CAST(n_annotations AS BIGINT) AS n_annotations, CAST(n_found AS BIGINT) AS n_found, CAST(n_detections AS BIGINT) AS n_detections, CAST(n_correct AS BIGINT) AS n_correct, rp AS ref_precision, round(rec, 9) AS ref_recall,
round(2 * rp * rec / (rp + rec), 9) AS ref_f1, round(pre, 9) AS precision, round(rec, 9) AS recall, round(2 * pre * rec / (pre + rec), 9) AS f1 FROM r""")
def detection_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of detections at IoU 0.5, list-based and standard."""
    lines = _lines(spark, sf_dir).select("line_pk", "page", "box")
    scored = metrics.detection_scores(lines, _detections(lines), "page")
    return scored.withColumns({c: _round(c) for c in ("ref_recall", "ref_f1", "precision", "recall", "f1")})


@query(f"""WITH {_BOXES} SELECT line_pk FROM b a WHERE NOT {_MET.format("d")}""")
def unmatched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations that no detection meets."""
    lines = _lines(spark, sf_dir).select("line_pk", "page", "box")
    found = metrics.matched_annotations(lines, _detections(lines), "page")
    return metrics.unmatched_annotations(lines, found, ["line_pk"]).select("line_pk")


_CELLS = """SELECT DISTINCT page, unnest(generate_series(CAST(floor(x1 / 20.0) AS INT), CAST(floor((x2 - 1) / 20.0) AS INT))) AS cx, cy FROM
(SELECT page, x1, x2, unnest(generate_series(CAST(floor(y1 / 20.0) AS INT), CAST(floor((y2 - 1) / 20.0) AS INT))) AS cy FROM {} WHERE x2 > x1 AND y2 > y1)"""


@query(f"""WITH {_BOXES}, g AS ({_CELLS.format("b")}), p AS ({_CELLS.format("d")}),
f AS (SELECT coalesce(g.page, p.page) AS page, CAST(count_if(g.page IS NOT NULL AND p.page IS NOT NULL) AS DOUBLE) AS tp, CAST(count(g.page) AS DOUBLE) AS g, CAST(count(p.page) AS DOUBLE) AS p
FROM g FULL JOIN p ON g.page = p.page AND g.cx = p.cx AND g.cy = p.cy GROUP BY 1)
SELECT page, round(CASE WHEN g = 0 THEN 0.0 ELSE tp / g END, 9) AS region_coverage, round(tp / (g + p - tp + 1e-10), 9) AS iou, round(2 * tp / (p + g + 1e-10), 9) AS dice,
round((tp + 10800 - g - p + tp) / 10800, 9) AS pixel_accuracy, round((tp / (g + 1e-10) + (10800 - g - p + tp) / (10800 - g + 1e-10)) / 2, 9) AS mean_pixel_accuracy FROM f""")
def cell_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask scores of each page on a grid of 20 pixels."""
    lines = _lines(spark, sf_dir).select("line_pk", "page", "box")
    scored = metrics.cell_scores(lines, _detections(lines), "page", 20, WIDTH // 20, HEIGHT // 20)
    return scored.withColumns({c: _round(c) for c in scored.columns if c != "page"})


_AREA = """SELECT page, sum((high - low) * (y2 - y1)) AS area FROM (
  SELECT page, y1, y2, island, min(x1) AS low, max(x2) AS high FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY page, y1 ORDER BY x1, x2 ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN x1 <= max(x2) OVER (PARTITION BY page, y1 ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
      FROM (SELECT DISTINCT s.page, s.y1, s.y2, o.x1, o.x2 FROM slabs s JOIN {} o ON o.page = s.page AND o.y1 <= s.y1 AND o.y2 >= s.y2 WHERE o.x2 > o.x1))) GROUP BY page, y1, y2, island) GROUP BY page"""


@query(f"""WITH {_BOXES}, u AS (SELECT page, x1, y1, x2, y2 FROM b UNION ALL SELECT page, x1, y1, x2, y2 FROM d), ys AS (SELECT DISTINCT page, y1 AS y FROM u UNION SELECT DISTINCT page, y2 FROM u),
slabs AS (SELECT page, y AS y1, y2 FROM (SELECT page, y, lead(y) OVER (PARTITION BY page ORDER BY y) AS y2 FROM ys) WHERE y2 IS NOT NULL),
p AS (SELECT DISTINCT page FROM u), ta AS ({_AREA.format("b")}), da AS ({_AREA.format("d")}), ua AS ({_AREA.format("u")})
SELECT p.page, CAST(coalesce(ta.area, 0) + coalesce(da.area, 0) - coalesce(ua.area, 0) AS BIGINT) AS covered, CAST(coalesce(ta.area, 0) AS BIGINT) AS area FROM p LEFT JOIN ta USING (page) LEFT JOIN da USING (page) LEFT JOIN ua USING (page)""")
def box_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact covered and whole area of each page's boxes (M6)."""
    lines = _lines(spark, sf_dir).select("line_pk", "page", "box")
    return metrics.box_coverage(lines, _detections(lines), "page")


@query(f"""WITH {_BOXES}, u AS (SELECT page, x1, y1, x2, y2 FROM b UNION ALL SELECT page, x1, y1, x2, y2 FROM d), ys AS (SELECT DISTINCT page, y1 AS y FROM u UNION SELECT DISTINCT page, y2 FROM u),
slabs AS (SELECT page, y AS y1, y2 FROM (SELECT page, y, lead(y) OVER (PARTITION BY page ORDER BY y) AS y2 FROM ys) WHERE y2 IS NOT NULL),
p AS (SELECT DISTINCT page FROM u), ta AS ({_AREA.format("b")}), da AS ({_AREA.format("d")}), ua AS ({_AREA.format("u")})
SELECT p.page, CAST(coalesce(ta.area, 0) + coalesce(da.area, 0) - coalesce(ua.area, 0) AS BIGINT) AS covered, CAST(coalesce(ta.area, 0) AS BIGINT) AS area FROM p LEFT JOIN ta USING (page) LEFT JOIN da USING (page) LEFT JOIN ua USING (page)""")
def polygon_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact covered and whole area of each page's polygons, here those of boxes (M6)."""
    lines = _lines(spark, sf_dir).select("line_pk", "page", "box")
    drawn = lambda rows: rows.select("page", G.bbox_polygon(F.col("box")).alias("polygon"))
    return metrics.polygon_coverage(drawn(lines), drawn(_detections(lines)), "page")


@query()
def assigned_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best one-to-one assignment of lines and detections."""
    lines = _lines(spark, sf_dir).select("line_pk", "page", "box")
    return metrics.match_boxes(lines, _detections(lines), "page", "line_pk")


@query()
def matched_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of lines and moved lines matched and scored (M8, M13 to M16), averaged over pages (A3)."""
    lines = _lines(spark, sf_dir).where("polygon is not null").select("page", F.col("line_pk").alias("k"), "polygon")
    moved = lines.withColumn("polygon", G.shift_polygon(F.col("polygon"), (F.col("k") % 9).cast("int"), (F.col("k") % 5).cast("int")))
    both = lines.withColumn("is_truth", F.lit(True)).unionByName(moved.withColumn("is_truth", F.lit(False)))
    return metrics.mean_metrics(metrics.match_masks(both, "page", scale=8), ["page"])


_SHARED = "greatest(least(k[3], x[1][3]) - greatest(k[1], x[1][1]), 0) * greatest(least(k[4], x[1][4]) - greatest(k[2], x[1][2]), 0)"
_OWN, _OTHER = "((x[1][3] - x[1][1]) * (x[1][4] - x[1][2]))", "((k[3] - k[1]) * (k[4] - k[2]))"
_ABSORBS = f"(({_OWN} + {_OTHER} - {_SHARED} <> 0 AND {_SHARED} / ({_OWN} + {_OTHER} - {_SHARED}) > 0.2) OR (least({_OWN}, {_OTHER}) <> 0 AND {_SHARED} / least({_OWN}, {_OTHER}) >= 0.5))"
_TAKER = f"coalesce(list_position(list_transform(z, lambda k: {_ABSORBS}), true), 0)"
_MERGED = f"list_transform(z, lambda k, j: CASE WHEN j = {_TAKER} THEN [least(k[1], x[1][1]), least(k[2], x[1][2]), greatest(k[3], x[1][3]), greatest(k[4], x[1][4])] ELSE k END)"


@query(f"""WITH RECURSIVE {_BOXES}, o AS (SELECT page, [CAST(x1 AS DOUBLE), y1, x2, y2] AS box, concat('{{', line_pk, ', [', x1, ', ', y1, ', ', x2, ', ', y2, ']}}') AS o FROM (SELECT line_pk, page, x1, y1, x2, y2 FROM b UNION ALL SELECT line_pk, page, x1, y1, x2, y2 FROM d)),
m AS (SELECT page, CAST(-1 AS BIGINT) AS n, list(box ORDER BY o) AS boxes FROM o GROUP BY page UNION ALL
  SELECT page, len(boxes), list_reduce(list_transform(boxes, lambda y: [y]), lambda z, x: CASE WHEN {_TAKER} > 0 THEN {_MERGED} ELSE list_append(z, x[1]) END) FROM m WHERE n <> len(boxes))
SELECT page, CAST(i - 1 AS INT) AS position, CAST(boxes[i][1] AS INT) AS x1, CAST(boxes[i][2] AS INT) AS y1, CAST(boxes[i][3] AS INT) AS x2, CAST(boxes[i][4] AS INT) AS y2 FROM (SELECT page, boxes, unnest(range(1, len(boxes) + 1)) AS i FROM m WHERE n = len(boxes))""")
def merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping boxes of each page merged."""
    lines = _lines(spark, sf_dir).select("line_pk", "page", "box")
    merged = layout.merge_overlapping(lines.unionByName(_detections(lines)).withColumn("o", F.struct("line_pk", "box").cast("string")), "page", "o")
    return merged.select("page", "position", *(c.cast("int").alias(n) for c, n in zip(G.corners(F.col("box")), G.CORNERS, strict=True)))


@query("""SELECT line_pk, list_min(list_transform(polygon, lambda p: p.x)) AS x1, list_min(list_transform(polygon, lambda p: p.y)) AS y1, list_max(list_transform(polygon, lambda p: p.x)) AS x2, list_max(list_transform(polygon, lambda p: p.y)) AS y2, CAST(len(polygon) AS INT) AS n_points
FROM text_lines WHERE polygon IS NOT NULL""")
def polygon_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as text, parsed, and the box around them."""
    lines = _lines(spark, sf_dir).where("polygon is not null")
    parsed = lines.select("line_pk", G.parse_points(G.format_points(F.col("polygon"))).alias("p"))
    return parsed.select("line_pk", *(c.alias(n) for c, n in zip(G.corners(G.polygon_bbox(F.col("p"))), G.CORNERS, strict=True)), F.size("p").alias("n_points"))


@query("""SELECT line_pk, bbox[3] - bbox[1] AS w, bbox[4] - bbox[2] AS h, bbox[3] AS x2, bbox[4] AS y2, concat(bbox[1], ',', bbox[2], ' ', bbox[1], ',', bbox[4], ' ', bbox[3], ',', bbox[4], ' ', bbox[3], ',', bbox[2]) AS corners FROM text_lines""")
def box_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as polygons and by width and height and back."""
    whole = G.to_xywh(F.col("box"))
    back = G.corners(G.from_xywh(whole))
    return _lines(spark, sf_dir).select("line_pk", G.corners(whole)[2].alias("w"), G.corners(whole)[3].alias("h"), back[2].alias("x2"), back[3].alias("y2"), G.format_points(G.bbox_polygon(F.col("box"))).alias("corners"))


_COVER = """c AS (SELECT page, region_id, min(x1) AS cx1, min(y1) AS cy1, max(x2) AS cx2, max(y2) AS cy2 FROM b WHERE region_id IS NOT NULL GROUP BY page, region_id)"""


@query(f"""WITH {_BOXES}, {_COVER} SELECT line_pk, x1 - cx1 AS x1, y1 - cy1 AS y1, x2 - cx1 AS x2, y2 - cy1 AS y2, x1 AS back_x1, y2 AS back_y2 FROM b JOIN c USING (page, region_id)""")
def crop_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines moved into their region's crop and back."""
    lines = _lines(spark, sf_dir).where("region_id is not null").select("line_pk", "page", "region_id", "box", "polygon")
    joined = lines.join(layout.cover_bbox(lines, ["page", "region_id"]), ["page", "region_id"])
    moved = records.in_crop(joined, "cover")
    back = records.on_page(moved.withColumn("crop_box", F.col("box")), "cover")
    corners = G.corners(F.col("box"))
    return back.select("line_pk", *(c.alias(n) for c, n in zip(G.corners(F.col("crop_box")), G.CORNERS, strict=True)), corners[0].alias("back_x1"), corners[3].alias("back_y2"))


@query(f"""WITH {_BOXES}, {_COVER} SELECT page, region_id, cx1 AS x1, cy1 AS y1, cx2 AS x2, cy2 AS y2 FROM c""")
def cover_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around each region's lines."""
    cover = layout.cover_bbox(_lines(spark, sf_dir).where("region_id is not null"), ["page", "region_id"])
    return cover.select("page", "region_id", *(c.alias(n) for c, n in zip(G.corners(F.col("cover")), G.CORNERS, strict=True)))


@query(f"""WITH {_BOXES}, {_COVER}, k AS (SELECT line_pk, x1, y1, x2, y2, cx1 + 20 AS u1, cy1 + 10 AS v1, cx2 - 20 AS u2, cy2 - 10 AS v2 FROM b JOIN c USING (page, region_id)),
s AS (SELECT *, greatest(0, least(x2, u2) - greatest(x1, u1)) * greatest(0, least(y2, v2) - greatest(y1, v1)) > 0 AS hit FROM k)
SELECT line_pk, CASE WHEN hit THEN greatest(x1, u1) ELSE x1 END AS x1, CASE WHEN hit THEN greatest(y1, v1) ELSE y1 END AS y1, CASE WHEN hit THEN least(x2, u2) ELSE x2 END AS x2, CASE WHEN hit THEN least(y2, v2) ELSE y2 END AS y2 FROM s""")
def clipped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines' boxes clipped to a region that is a little too small (J10 for boxes)."""
    lines = _lines(spark, sf_dir).where("region_id is not null").select("line_pk", "page", "region_id", "box")
    joined = lines.join(layout.cover_bbox(lines, ["page", "region_id"]), ["page", "region_id"])
    x1, y1, x2, y2 = G.corners(F.col("cover"))
    clipped = G.clip(F.col("box"), G.box(x1 + 20, y1 + 10, x2 - 20, y2 - 10))
    return joined.select("line_pk", *(c.alias(n) for c, n in zip(G.corners(clipped), G.CORNERS, strict=True)))


@query()
def clipped_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines' polygons clipped to their region and moved to its origin."""
    lines = _lines(spark, sf_dir).where("region_id is not null and polygon is not null").select("line_pk", "page", "region_id", "box", "polygon")
    regions = layout.cover_bbox(lines, ["page", "region_id"]).select("page", "region_id", G.bbox_polygon(F.col("cover")).alias("region_polygon"))
    return layout.clip_to_regions(lines, regions, ["page", "region_id"], "line_pk")


@query("""SELECT line_pk, round((bbox[1] + bbox[3]) / 2.0 / 1800, 9) AS xc, round((bbox[2] + bbox[4]) / 2.0 / 2400, 9) AS yc, round((bbox[3] - bbox[1]) / 1800.0, 9) AS w, round((bbox[4] - bbox[2]) / 2400.0, 9) AS h FROM text_lines""".replace("2.0", "CAST(2 AS DOUBLE)").replace("1800.0", "CAST(1800 AS DOUBLE)").replace("2400.0", "CAST(2400 AS DOUBLE)"))
def yolo_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by centre and size as shares of the page."""
    shares = G.corners(G.yolo_box(F.col("box"), F.lit(WIDTH), F.lit(HEIGHT)))
    return _lines(spark, sf_dir).select("line_pk", *(_round(c).alias(n) for c, n in zip(shares, ("xc", "yc", "w", "h"), strict=True)))


@query("""SELECT img_filename AS page, string_agg(concat('0 ', CAST((bbox[1] + bbox[3]) / CAST(2 AS DOUBLE) / 1800 AS VARCHAR), ' ', CAST((bbox[2] + bbox[4]) / CAST(2 AS DOUBLE) / 2400 AS VARCHAR), ' ', CAST((bbox[3] - bbox[1]) / CAST(1800 AS DOUBLE) AS VARCHAR), ' ', CAST((bbox[4] - bbox[2]) / CAST(2400 AS DOUBLE) AS VARCHAR)), chr(10) ORDER BY line_pk) AS label FROM text_lines GROUP BY 1""")
def yolo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label file of each page as text."""
    lines = _lines(spark, sf_dir).select("page", "line_pk", "box", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
    return sinks.yolo_labels(lines, "page", "line_pk")


@query("""SELECT img_filename AS page, string_agg(concat('0 ', array_to_string(list_transform(polygon, lambda p: concat(printf('%.6f', CAST(p.x AS DOUBLE) / 1800), ' ', printf('%.6f', CAST(p.y AS DOUBLE) / 2400))), ' ')), chr(10) ORDER BY line_pk) AS label FROM text_lines WHERE polygon IS NOT NULL GROUP BY 1""")
def yolo_polygon_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygon label file of each page as text."""
    lines = _lines(spark, sf_dir).where("polygon is not null").select("page", "line_pk", "polygon", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
    return sinks.yolo_polygons(lines, "page", "line_pk")


@query("""SELECT line_pk, 3 AS class_id, CAST(len(polygon) AS INT) AS n_points, round(CAST(polygon[1].x AS DOUBLE), 6) AS x, round(CAST(polygon[-1].y AS DOUBLE), 6) AS y FROM text_lines WHERE len(polygon) > 0""")
def yolo_polygons_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons encoded as shares of the page and decoded again."""
    label = F.concat(F.lit("3 "), F.array_join(F.transform(G.yolo_polygon(F.col("polygon"), F.lit(WIDTH), F.lit(HEIGHT)), lambda v: v.cast("string")), " "))
    decoded = _lines(spark, sf_dir).where(F.size("polygon") > 0).select("line_pk", G.decode_yolo(label, F.lit(WIDTH), F.lit(HEIGHT)).alias("d"))
    return decoded.select("line_pk", "d.class_id", F.size("d.polygon").alias("n_points"), _round(F.col("d.polygon")[0]["x"], 6).alias("x"), _round(F.element_at("d.polygon", -1)["y"], 6).alias("y"))


_BIN = "CAST(least(greatest(floor({} / (CAST({} AS DOUBLE) / 1000)), 0), 999) AS INT)"


@query(f"""WITH q AS (SELECT line_pk, {_BIN.format("bbox[1]", 1800)} AS q1, {_BIN.format("bbox[2]", 2400)} AS q2, {_BIN.format("bbox[3]", 1800)} AS q3, {_BIN.format("bbox[4]", 2400)} AS q4 FROM text_lines)
SELECT *, round((q1 + CAST(0.5 AS DOUBLE)) * (CAST(1800 AS DOUBLE) / 1000), 6) AS d1, round((q4 + CAST(0.5 AS DOUBLE)) * (CAST(2400 AS DOUBLE) / 1000), 6) AS d4 FROM q""")
def quantised_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in bins and the middles of their bins."""
    q = G.corners(G.quantise_box(F.col("box"), F.lit(WIDTH), F.lit(HEIGHT)))
    rows = _lines(spark, sf_dir).select("line_pk", *(c.alias(f"q{i + 1}") for i, c in enumerate(q)))
    return rows.select("*", _round(G.dequantise(F.col("q1"), F.lit(WIDTH)), 6).alias("d1"), _round(G.dequantise(F.col("q4"), F.lit(HEIGHT)), 6).alias("d4"))


@query(f"""SELECT line_pk, array_to_string(list_transform(polygon, lambda p: concat({_BIN.format("p.x", 1800)}, ',', {_BIN.format("p.y", 2400)})), ' ') AS bins,
round(coalesce(list_sum(list_transform(polygon, lambda p: ({_BIN.format("p.x", 1800)} + CAST(0.5 AS DOUBLE)) * (CAST(1800 AS DOUBLE) / 1000) + ({_BIN.format("p.y", 2400)} + CAST(0.5 AS DOUBLE)) * (CAST(2400 AS DOUBLE) / 1000))), 0), 6) AS middles FROM text_lines WHERE polygon IS NOT NULL""")
def quantised_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons in bins, and the sum of the middles of these."""
    lines = _lines(spark, sf_dir).where("polygon is not null").select("line_pk", G.quantise_polygon(F.col("polygon"), F.lit(WIDTH), F.lit(HEIGHT)).alias("q"))
    middles = F.aggregate(G.dequantise_polygon(F.col("q"), F.lit(WIDTH), F.lit(HEIGHT)), F.lit(0.0), lambda z, p: z + p["x"] + p["y"])
    return lines.select("line_pk", G.format_points(F.col("q")).alias("bins"), _round(middles, 6).alias("middles"))


@query(f"""SELECT img_filename AS page, string_agg(concat('line_bbox<loc_', {_BIN.format("bbox[1]", 1800)}, '><loc_', {_BIN.format("bbox[2]", 2400)}, '><loc_', {_BIN.format("bbox[3]", 1800)}, '><loc_', {_BIN.format("bbox[4]", 2400)}, '>'), '' ORDER BY line_pk) AS answer FROM text_lines GROUP BY img_filename""")
def detection_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected answer of line detection for each page."""
    return records.detection_answers(_lines(spark, sf_dir), ["page"], "line_pk", F.lit(WIDTH), F.lit(HEIGHT))


@query("""SELECT line_pk, CAST(len(polygon) + 1 AS INT) AS n_points, polygon[1].x AS first_x, polygon[1].x AS last_x FROM text_lines WHERE len(polygon) > 0""")
def closed_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons exported as closed rings."""
    ring = G.close_ring(F.col("polygon"))
    return _lines(spark, sf_dir).where(F.size("polygon") > 0).select("line_pk", F.size(ring).alias("n_points"), ring[0]["x"].alias("first_x"), F.element_at(ring, -1)["x"].alias("last_x"))


# --- keys, filters and joins -----------------------------------------------------------------------------------------


@query("""SELECT line_pk, concat(img_filename, '_', printf('%04d', row_number() OVER (PARTITION BY img_filename ORDER BY unique_key, line_pk) - 1)) AS unique_key FROM text_lines WHERE transcription IS NOT NULL""")
def dense_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys numbered after rows without text are dropped."""
    lines = _lines(spark, sf_dir).where("transcription is not null")
    return records.dense_keys(lines, "page", ["key", "line_pk"]).select("line_pk", "unique_key")


@query("""SELECT line_pk, unique_key FROM (SELECT line_pk, transcription, concat(img_filename, '_', printf('%04d', row_number() OVER (PARTITION BY img_filename ORDER BY unique_key, line_pk) - 1)) AS unique_key FROM text_lines) WHERE transcription <> ''""")
def gapped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys numbered before rows without text are dropped."""
    return records.gapped_keys(_lines(spark, sf_dir), F.col("transcription") != "", "page", ["key", "line_pk"]).select("line_pk", "unique_key")


@query(r"""SELECT sample_id, string_split(img_path, '/')[-2] AS volume, regexp_replace(string_split(img_path, '/')[-1], '^(.+)\.[^.]*$', '\1') AS stem, regexp_extract(img_path, '(\.[^./]+)$', 1) AS suffix,
regexp_extract(img_path, '(\.[^./]+)$', 1) IN ('.jpg', '.jpeg', '.png', '.gif', '.bmp', '.tif', '.tiff', '.JPG', '.JPEG', '.PNG', '.GIF', '.BMP', '.TIF', '.TIFF') AS is_image FROM region_samples WHERE img_path IS NOT NULL""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder, stem and suffix of image paths."""
    path = F.col("img_path")
    rows = table(spark, sf_dir, "region_samples").where("img_path is not null")
    return rows.select("sample_id", records.volume(path).alias("volume"), records.stem(path).alias("stem"), records.suffix(path).alias("suffix"), records.suffix(path).isin(*records.IMAGE_SUFFIXES).alias("is_image"))


@query("""SELECT volume_id, nfc_normalize(img_volume) AS name, strlen(nfc_normalize(img_volume)) < strlen(img_volume) AS was_decomposed FROM volumes""")
def normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names decomposed and composed again by Arrow kernels."""
    from docflow.functions.text import nfc, nfd

    rows = table(spark, sf_dir, "volumes").select("volume_id", "img_volume", nfc(nfd(F.col("img_volume"))).alias("name"))
    return rows.select("volume_id", "name", (F.octet_length("name") < F.octet_length("img_volume")).alias("was_decomposed"))


@query("""SELECT DISTINCT img_filename AS page FROM page_annotations p WHERE EXISTS (SELECT 1 FROM text_lines t WHERE t.img_filename = p.img_filename AND t.transcription <> '')""")
def pages_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that have a line with text."""
    pages = table(spark, sf_dir, "page_annotations").select(F.col("img_filename").alias("page")).distinct()
    return pages.join(_lines(spark, sf_dir).where("transcription <> ''"), "page", "left_semi")


@query("""SELECT img_filename AS page, region_id, count(*) AS n_lines FROM text_lines WHERE region_id IS NOT NULL AND len(polygon) >= 3 AND transcription IS NOT NULL GROUP BY img_filename, region_id HAVING count(*) > 0""")
def regions_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with a whole line."""
    whole = _lines(spark, sf_dir).where("region_id is not null and transcription is not null").where(F.size("polygon") >= 3)
    return whole.groupBy("page", "region_id").agg(F.count("*").alias("n_lines")).where("n_lines > 0")


@query("""SELECT line_pk, concat('<OCR>', coalesce(region_id, '')) AS prompt, replace(concat('<pad>', transcription, '<pad>'), '<pad>', '') AS answer FROM text_lines WHERE transcription IS NOT NULL""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts and answers without padding."""
    lines = _lines(spark, sf_dir).where("transcription is not null")
    return lines.select("line_pk", records.prompt(F.lit(records.TASKS["ocr"]), F.col("region_id")).alias("prompt"), records.strip_padding(F.concat(F.lit("<pad>"), "transcription", F.lit("<pad>"))).alias("answer"))


@query("""WITH i AS (SELECT DISTINCT img_filename AS k FROM region_samples), a AS (SELECT DISTINCT img_filename AS k FROM page_annotations), f AS (SELECT i.k AS ik, a.k AS ak FROM i FULL JOIN a ON i.k = a.k)
SELECT CAST(count(ik) AS BIGINT) AS n_images, CAST(count(ak) AS BIGINT) AS n_annotations, CAST(count_if(ik IS NOT NULL AND ak IS NOT NULL) AS BIGINT) AS n_pairs,
count_if(ik IS NOT NULL AND ak IS NOT NULL) > 0 AND count(ik) = count_if(ik IS NOT NULL AND ak IS NOT NULL) AND count(ak) = count_if(ik IS NOT NULL AND ak IS NOT NULL) AS complete FROM f""")
def pairing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images against annotations by stem."""
    return records.pairing_report(table(spark, sf_dir, "region_samples").select(F.col("img_filename").alias("k")), table(spark, sf_dir, "page_annotations").select(F.col("img_filename").alias("k")), "k")


_MANIFEST = """m AS (SELECT scheme, unnest(train) AS name, 0 AS o FROM split_info UNION ALL SELECT scheme, unnest(val), 1 FROM split_info UNION ALL SELECT scheme, unnest(test), 2 FROM split_info)"""


def _manifest(spark: SparkSession, sf_dir: str, scheme: str) -> DataFrame:
    listed = table(spark, sf_dir, "split_info").where(F.col("scheme") == scheme)
    return files.unite([listed.select(F.explode(s).alias("name"), F.lit(s).alias("split")) for s in ("train", "val", "test")]).where("name is not null")


def _schemes(found: Callable[[str], DataFrame]) -> DataFrame:
    """The rows of both schemes of manifests."""
    return files.unite([found(s).withColumn("scheme", F.lit(s)) for s in ("mixed", "sbs")])


@query(f"""WITH {_MANIFEST}, s AS (SELECT scheme, name, min(o) AS o FROM m WHERE name IS NOT NULL GROUP BY scheme, name) SELECT scheme, sample_id, CASE o WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM region_samples JOIN s ON img_filename = name""")
def samples_by_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of each scheme that lists a sample's page."""
    samples = table(spark, sf_dir, "region_samples").select("sample_id", F.col("img_filename").alias("name"))
    return _schemes(lambda scheme: splits.attach(samples, _manifest(spark, sf_dir, scheme), "name").select("sample_id", "split"))


@query(f"""WITH {_MANIFEST}, d AS (SELECT DISTINCT scheme, name, o FROM m WHERE name IS NOT NULL), c AS (SELECT * FROM (VALUES ('mixed'), ('sbs')) x(scheme), (VALUES (0, 1), (0, 2), (1, 2)) y(l, r))
SELECT scheme, ['train', 'val', 'test'][l + 1] AS "left", ['train', 'val', 'test'][r + 1] AS "right", (SELECT count(*) FROM d a JOIN d b USING (scheme, name) WHERE a.o = l AND b.o = r AND a.scheme = c.scheme) AS n_common FROM c""")
def common_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that two splits of a scheme share."""
    return _schemes(lambda scheme: splits.common_names(_manifest(spark, sf_dir, scheme), "name"))


@query("""SELECT DISTINCT img_filename AS page FROM text_lines WHERE img_filename NOT IN (SELECT img_filename FROM region_samples WHERE img_filename IS NOT NULL AND loaded_at > written_at + INTERVAL 1 DAY)""")
def unprocessed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without an output, which here is a sample loaded more than a day after it was written."""
    done = table(spark, sf_dir, "region_samples").where("loaded_at > written_at + interval 1 day").select(F.col("img_filename").alias("page"))
    return records.unprocessed(_lines(spark, sf_dir).select("page").distinct(), done, "page")


@query("""WITH c AS (SELECT img_filename AS page, CAST(count(*) AS BIGINT) AS n FROM text_lines GROUP BY img_filename), o AS (SELECT img_filename AS page, CAST(count(*) + 1000 AS BIGINT) AS n FROM region_samples GROUP BY img_filename)
SELECT c.page, coalesce(o.n, c.n) AS n, o.n IS NOT NULL AS cached FROM c LEFT JOIN o USING (page)""")
def cached_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored metrics where there are any, else computed ones."""
    computed = _lines(spark, sf_dir).groupBy("page").agg(F.count("*").alias("n"))
    stored = table(spark, sf_dir, "region_samples").groupBy(F.col("img_filename").alias("page")).agg((F.count("*") + 1000).alias("n"))
    return records.cached_or(computed.select("page"), stored, computed, "page", ["n"])


@query("""WITH a AS (SELECT img_filename AS page, CAST(count(*) AS BIGINT) AS n_lines FROM text_lines GROUP BY 1), b AS (SELECT img_filename AS page, CAST(count(*) AS BIGINT) AS n_samples FROM region_samples GROUP BY 1), c AS (SELECT img_filename AS page, CAST(count(*) AS BIGINT) AS n_records FROM page_annotations GROUP BY 1)
SELECT page, n_lines, n_samples, n_records FROM a FULL JOIN b USING (page) FULL JOIN c USING (page)""")
def metric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page metrics of several tables side by side."""
    count = lambda t, name: table(spark, sf_dir, t).groupBy(F.col("img_filename").alias("page")).agg(F.count("*").alias(name))
    return records.side_by_side([count("text_lines", "n_lines"), count("region_samples", "n_samples"), count("page_annotations", "n_records")], "page")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("""SELECT lower(trim(split)) AS split, CAST(count(*) AS BIGINT) AS n, CAST(count_if(transcription IS NULL OR transcription = '') AS BIGINT) AS n_empty, CAST(count(DISTINCT img_filename) AS BIGINT) AS n_pages FROM region_samples GROUP BY 1""")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, empty ones and pages of each split (A5)."""
    rows = table(spark, sf_dir, "region_samples").groupBy(F.lower(F.trim("split")).alias("split"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("transcription").isNull() | (F.col("transcription") == "")).alias("n_empty"), F.countDistinct("img_filename").alias("n_pages"))


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("step"), F.col("value").alias("loss"))


@query("""SELECT event_type AS model, arg_min(event_id, {'v': value, 's': event_id}) AS best, max(event_id) AS last FROM events GROUP BY event_type""")
def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best and the last step of each model."""
    rows = _checkpoints(spark, sf_dir)
    best = records.best_checkpoint(rows, "model", "step", "loss").withColumnRenamed("step", "best")
    return best.join(records.last_checkpoint(rows, "model", "step").withColumnRenamed("step", "last"), "model")


@query("""SELECT event_type AS model, event_id AS step, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 8) AS running FROM events""")
def running_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss so far (A10)."""
    return records.running_mean(_checkpoints(spark, sf_dir), "model", "step", "loss").select("model", "step", _round("running", 8).alias("running"))


@query("""SELECT event_type AS model, round(coalesce(sum(CASE WHEN event_id % 5 <> 0 THEN value END), 0) / count(*), 6) AS mean_loss FROM events GROUP BY event_type""")
def validation_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss with failed batches in the denominator."""
    rows = _checkpoints(spark, sf_dir).withColumn("loss", F.when(F.col("step") % 5 != 0, F.col("loss")))
    return records.validation_mean(rows, "model", "loss").select("model", _round("mean_loss", 6).alias("mean_loss"))


@query("""SELECT event_type AS model, round(sum(value) / 60, 6) AS minutes, round(avg(value), 6) AS seconds_each FROM events GROUP BY event_type""")
def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total minutes and mean seconds."""
    return _checkpoints(spark, sf_dir).groupBy("model").agg(_round(F.sum("loss") / 60, 6).alias("minutes"), _round(F.avg("loss"), 6).alias("seconds_each"))


@query("""SELECT label, CAST(sum(len(embedding)) AS BIGINT) AS n_parameters, round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 4) AS total FROM embeddings GROUP BY label""")
def parameter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and sum of values in arrays."""
    rows = table(spark, sf_dir, "embeddings")
    total = F.aggregate("embedding", F.lit(0.0), lambda n, x: n + x.cast("double"))
    return rows.groupBy("label").agg(F.sum(F.size("embedding")).alias("n_parameters"), _round(F.sum(total), 4).alias("total"))


@query("""SELECT event_id AS step, round(CAST(0.000001 AS DOUBLE) * (1 - CAST(event_id AS DOUBLE) / 200000) * 1e6, 9) AS rate FROM events""")
def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear learning rate at each step, in millionths."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), _round(records.linear_rate(1e-6, F.col("event_id"), 200_000) * 1e6).alias("rate"))


# --- order -----------------------------------------------------------------------------------------------------------

_PLACE = "CASE WHEN (x1 + x2) / 2.0 < 150 THEN 3 WHEN (x1 + x2) / 2.0 > 1500 THEN 4 WHEN (y1 + y2) / 2.0 < 200 THEN 0 WHEN (y1 + y2) / 2.0 > 2100 THEN 2 ELSE 1 END"


def _placed(lines: DataFrame) -> DataFrame:
    """Printspace and spread as inputs: pages with an odd number of bytes in their name are spreads."""
    return lines.withColumns({"printspace": F.array(*(F.lit(v) for v in (150, 200, 1500, 2100))), "two_pages": F.octet_length("page") % 2 == 1})


@query(f"""WITH {_BOXES} SELECT line_pk, CAST(row_number() OVER (PARTITION BY page ORDER BY (strlen(page) % 2 = 1 AND x1 + x2 > 1650), {_PLACE}, y1, line_pk) - 1 AS INT) AS position FROM b""")
def margin_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order by spread half, margin and height."""
    return layout.order_with_margins(_placed(_lines(spark, sf_dir)), "page", "line_pk").select("line_pk", "position")


@query(f"""WITH {_BOXES}, s AS (SELECT page, list_sort(list((x1 + x2) / 2.0))[CAST(floor(count(*) / 2.0) AS INT) + 1] AS split FROM b GROUP BY page)
SELECT line_pk, CAST(row_number() OVER (PARTITION BY page ORDER BY CASE WHEN (x1 + x2) / 2.0 >= split THEN 1 ELSE 0 END, y1, x1, line_pk) - 1 AS INT) AS position FROM b JOIN s USING (page)""")
def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order in two columns."""
    return layout.order_columns(_lines(spark, sf_dir), "page", "line_pk").select("line_pk", "position")


@query(f"""WITH RECURSIVE {_BOXES}, n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y1, x1, line_pk) AS r FROM b),
w AS (SELECT page, r, line_pk, x1, y1, y1 AS anchor, 0 AS band FROM n WHERE r = 1
UNION ALL SELECT n.page, n.r, n.line_pk, n.x1, n.y1, CASE WHEN abs(n.y1 - w.anchor) > 10 THEN n.y1 ELSE w.anchor END, CASE WHEN abs(n.y1 - w.anchor) > 10 THEN w.band + 1 ELSE w.band END FROM w JOIN n ON n.page = w.page AND n.r = w.r + 1)
SELECT line_pk, band, CAST(row_number() OVER (PARTITION BY page ORDER BY band, x1, y1, line_pk) - 1 AS INT) AS position FROM w""")
def band_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order by horizontal bands with anchors."""
    return layout.order_bands(_lines(spark, sf_dir), "page", "line_pk").select("line_pk", "band", "position")


_PAGE_ORDER = f"""WITH {_BOXES.replace("region_id, bbox", "coalesce(region_id, '') AS region_id, bbox")}, {_COVER}, p AS (SELECT page, region_id, row_number() OVER (PARTITION BY page ORDER BY (strlen(page) % 2 = 1 AND cx1 + cx2 > 1650), {_PLACE.replace("x1", "cx1").replace("x2", "cx2").replace("y1", "cy1").replace("y2", "cy2")}, cy1, region_id) - 1 AS rp FROM c),
q AS (SELECT line_pk, page, region_id, row_number() OVER (PARTITION BY page, region_id ORDER BY (strlen(page) % 2 = 1 AND x1 + x2 > 1650), {_PLACE}, y1, line_pk) - 1 AS lp FROM b)
SELECT line_pk, CAST(row_number() OVER (PARTITION BY page ORDER BY rp, lp) - 1 AS INT) AS position FROM q JOIN p USING (page, region_id)"""


@query(_PAGE_ORDER)
def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions in order, then lines within each (W4); lines without a region are a region of their own."""
    from pyspark.sql import Window

    lines = _lines(spark, sf_dir).select("line_pk", "page", F.coalesce("region_id", F.lit("")).alias("region_id"), "box")
    regions = layout.cover_bbox(lines, ["page", "region_id"]).withColumnRenamed("cover", "box")
    first = layout.order_with_margins(_placed(regions), "page", "region_id").select("page", "region_id", F.col("position").alias("rp"))
    group = F.struct("page", "region_id")
    second = layout.order_with_margins(_placed(lines).withColumn("g", group), "g", "line_pk").select("line_pk", "page", "region_id", F.col("position").alias("lp"))
    place = (F.row_number().over(Window.partitionBy("page").orderBy("rp", "lp")) - 1).cast("int")
    return second.join(first, ["page", "region_id"]).select("line_pk", place.alias("position"))


@query(f"""SELECT img_filename AS page, string_agg(transcription, ' ' ORDER BY position) AS text, string_agg(transcription, ' ' ORDER BY line_pk) AS legacy FROM text_lines JOIN ({_PAGE_ORDER}) USING (line_pk) WHERE transcription IS NOT NULL GROUP BY 1""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of pages in reading order and, as they once were joined, in the order of detection."""
    lines = page_order(spark, sf_dir).join(_lines(spark, sf_dir).select("line_pk", "page", "transcription"), "line_pk")
    read, legacy = (layout.page_texts(lines, "page", "line_pk", "transcription", old).withColumnRenamed("transcription", name) for name, old in (("text", False), ("legacy", True)))
    return read.join(legacy, "page")


@query("""WITH n AS (SELECT volume_id, CAST(row_number() OVER (ORDER BY img_volume) - 1 AS INT) AS index FROM volumes) SELECT volume_id, index FROM n WHERE index >= 2 AND index < (SELECT count(*) FROM volumes) - 1 AND (index - 2) % 3 = 0""")
def sliced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third volume from the third on."""
    return records.select_rows(table(spark, sf_dir, "volumes"), ["img_volume"], 2, None, 3).select("volume_id", "index")


@query("""SELECT line_pk, CAST(floor((row_number() OVER (PARTITION BY img_filename ORDER BY unique_key, line_pk) - 1) / 8.0) AS INT) AS batch FROM text_lines""")
def batched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of eight lines within a page."""
    return records.batches(_lines(spark, sf_dir), ["page"], ["key", "line_pk"], 8).select("line_pk", "batch")


@query("""SELECT DISTINCT img_filename AS page FROM text_lines ORDER BY page LIMIT 100""")
def first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred pages by name, the timing runs' input (W7, W9); the limit is the feature."""
    return _lines(spark, sf_dir).select("page").distinct().orderBy("page").limit(100)


# --- sets and splits -------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT DISTINCT img_filename AS page FROM text_lines), n AS (SELECT page, row_number() OVER (ORDER BY md5(concat('42|', page)), page) AS r, count(*) OVER () AS t FROM p), c AS (SELECT *, CAST(ceil(t * CAST(0.1 AS DOUBLE)) AS BIGINT) AS k FROM n)
SELECT page, CASE WHEN r <= k THEN 'test' WHEN r <= k + ceil((t - k) * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM c""")
def mixed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the pages to test, a tenth of the rest to val (U4)."""
    return splits.mixed(_lines(spark, sf_dir).select("page").distinct(), "page")


_TRAIN_SOURCES, _TEST_SOURCES = ("Björkö_tingslag", "Mårdnäs_häradsrätt"), ("Västerhamns_rådhusrätt", "Ödesjö_bruk")


@query("""WITH r AS (SELECT volume_id, source, row_number() OVER (ORDER BY md5(concat('42|', volume_id)), volume_id) AS r, count(*) OVER () AS t FROM volumes WHERE source IN ('Björkö_tingslag', 'Mårdnäs_häradsrätt'))
SELECT volume_id, CASE WHEN r <= ceil(t * CAST(0.07 AS DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM r UNION ALL SELECT volume_id, 'test' FROM volumes WHERE source IN ('Västerhamns_rådhusrätt', 'Ödesjö_bruk')""")
def source_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sources to test, seven percent of the others to val."""
    volumes = table(spark, sf_dir, "volumes").select("volume_id", "source")
    return splits.by_source(volumes, "volume_id", "source", _TRAIN_SOURCES, _TEST_SOURCES).select("volume_id", "split")


@query("""WITH r AS (SELECT sample_id, row_number() OVER (ORDER BY md5(concat('42|', sample_id)), sample_id) AS r, count(*) OVER () AS t FROM region_samples), c AS (SELECT *, floor(t * CAST(0.7 AS DOUBLE)) AS a, floor(t * CAST(0.15 AS DOUBLE)) AS b FROM r)
SELECT sample_id, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'val' ELSE 'test' END AS split FROM c""")
def count_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seventy, fifteen and the remaining percent."""
    return splits.by_counts(table(spark, sf_dir, "region_samples").select("sample_id"), "sample_id").select("sample_id", "split")


@query("""SELECT sample_id, CAST(i - 1 AS INT) AS position, bboxes[i][1] AS x1, bboxes[i][4] AS y2 FROM (SELECT *, unnest(generate_series(1, len(bboxes))) AS i FROM region_samples)""")
def flattened_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples' line boxes, one a row."""
    rows = table(spark, sf_dir, "region_samples").select("sample_id", F.posexplode("bboxes").alias("position", "box"))
    return rows.select("sample_id", "position", G.corners(F.col("box"))[0].alias("x1"), G.corners(F.col("box"))[3].alias("y2"))


@query(f"""WITH {_BOXES}, {_COVER}, r AS (SELECT page, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY page), l AS (SELECT img_filename AS page, CAST(count(*) AS BIGINT) AS n FROM text_lines WHERE polygon IS NOT NULL GROUP BY 1)
SELECT page, coalesce(r.n, 0) + coalesce(l.n, 0) AS n, CASE WHEN r.n > 0 THEN 'textregion' ELSE 'textline' END AS first_class, CASE WHEN l.n > 0 THEN 'textline' ELSE 'textregion' END AS last_class FROM r FULL JOIN l USING (page)""")
def page_annotations_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, then lines, as one list of annotations a page."""
    lines = _lines(spark, sf_dir)
    cover = layout.cover_bbox(lines.where("region_id is not null"), ["page", "region_id"])
    regions = cover.select("page", F.hash("region_id").alias("position"), G.bbox_polygon(F.col("cover")).alias("polygon"), F.lit("").alias("transcription"))
    rows = records.annotations_by_page(lines.where("polygon is not null").select("page", F.col("line_pk").alias("position"), "polygon", "transcription"), regions, "page")
    return rows.select("page", F.size("annotations").cast("long").alias("n"), F.col("annotations")[0]["class"].alias("first_class"), F.element_at("annotations", -1)["class"].alias("last_class"))


@query(f"""WITH {_BOXES}, {_COVER} SELECT page, region_id, CAST(count(*) AS INT) AS n, CAST(sum(x1 - cx1) AS BIGINT) AS sum_x1, 'line_bbox' AS class FROM b JOIN c USING (page, region_id) GROUP BY page, region_id""")
def region_samples_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's lines as boxes in its crop."""
    lines = _lines(spark, sf_dir).where("region_id is not null").withColumnRenamed("line_pk", "position")
    joined = lines.join(layout.cover_bbox(lines, ["page", "region_id"]), ["page", "region_id"])
    rows = records.annotations_in_regions(joined, "page", "region_id", with_text=False)
    total = F.aggregate("annotations", F.lit(0).cast("long"), lambda n, a: n + G.corners(a["box"])[0])
    return rows.select("page", "region_id", F.size("annotations").alias("n"), total.alias("sum_x1"), F.col("annotations")[0]["class"].alias("class"))


def _dataset(name: str, sql: str) -> None:
    """A query of a dataset variant: keys of its samples and, of their annotations, number, coordinates (summed), classes and texts."""
    from docflow.plans import datasets

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = _lines(spark, sf_dir).withColumnRenamed("line_pk", "position")
        rows = datasets.build(name, lines)
        zero = F.lit(0).cast("long")
        whole = lambda polygon: F.aggregate(polygon, zero, lambda z, p: z + p["x"] * 3 + p["y"])
        if "annotations" not in rows.columns:
            return rows.select("unique_key", "img_filename", F.size("crop").alias("n"), whole(F.col("crop")).alias("places"), F.lit("").alias("classes"), F.col("transcription").alias("texts"))
        boxed = "box" in rows.schema["annotations"].dataType.elementType.names
        place = lambda a: a["box"][0] * 3 + a["box"][1] + a["box"][2] * 5 + a["box"][3] * 7 if boxed else whole(a["polygon"])
        texts = F.lit("") if boxed else F.array_join(F.transform("annotations", lambda a: a["transcription"]), "|")
        classes = F.array_join(F.array_sort(F.array_distinct(F.transform("annotations", lambda a: a["class"]))), ",")
        return rows.select("unique_key", "img_filename", F.size("annotations").alias("n"), F.aggregate("annotations", zero, lambda z, a: z + place(a)).alias("places"), classes.alias("classes"), texts.alias("texts"))

    run.__name__ = run.__qualname__ = f"dataset_{name}"
    run.__doc__ = f"Samples of {name} (G5, D5)."
    query(sql)(run)


_SUM = "coalesce(list_sum(list_transform({}, lambda p: p.x * 3 + p.y)), 0)"
_AROUND = "2 * (3 * (list_min(list_transform(polygon, lambda p: p.x)) + list_max(list_transform(polygon, lambda p: p.x))) + list_min(list_transform(polygon, lambda p: p.y)) + list_max(list_transform(polygon, lambda p: p.y)))"
_NUMBERED = """SELECT concat(CASE WHEN img_volume IS NULL THEN '' ELSE concat(img_volume, '_') END, img_filename) AS k, img_filename, line_pk, transcription, CAST({} AS INT) AS n, CAST({} AS BIGINT) AS places FROM text_lines WHERE polygon IS NOT NULL"""
_GAPPED = "SELECT unique_key, img_filename, n, places, '' AS classes, transcription AS texts FROM (SELECT *, concat(k, '_', printf('%04d', row_number() OVER (PARTITION BY k ORDER BY line_pk) - 1)) AS unique_key FROM ({})) WHERE transcription <> ''"
_INSIDE = """WITH r AS (SELECT img_filename, region_id, min(line_pk) AS f, min(bbox[1]) AS cx1, min(bbox[2]) AS cy1, max(bbox[3]) AS cx2, max(bbox[4]) AS cy2 FROM text_lines WHERE region_id IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, concat(img_filename, '_', printf('%04d', row_number() OVER (PARTITION BY img_filename ORDER BY f, region_id) - 1)) AS unique_key FROM r),
l AS (SELECT k.unique_key, img_filename, line_pk, coalesce(transcription, '') AS t, polygon, cx1, cy1, cx2, cy2, list_min(list_transform(polygon, lambda p: p.x)) AS x1, list_min(list_transform(polygon, lambda p: p.y)) AS y1, list_max(list_transform(polygon, lambda p: p.x)) AS x2, list_max(list_transform(polygon, lambda p: p.y)) AS y2
  FROM k JOIN text_lines USING (img_filename, region_id) WHERE polygon IS NOT NULL),
m AS (SELECT *, least(x2, cx2) > greatest(x1, cx1) AND least(y2, cy2) > greatest(y1, cy1) AS hit FROM l)
"""
_INSIDE_SHAPES = _INSIDE + f"SELECT unique_key, img_filename, CAST(count(*) AS INT) AS n, CAST(sum({_SUM.format('polygon')} - len(polygon) * (3 * cx1 + cy1)) AS BIGINT) AS places, 'textline' AS classes, string_agg(t, '|' ORDER BY line_pk) AS texts FROM m GROUP BY 1, 2"
_INSIDE_BOXES = _INSIDE + """SELECT unique_key, img_filename, CAST(count(*) AS INT) AS n, CAST(sum(CASE WHEN hit THEN 3 * (greatest(x1, cx1) - cx1) + greatest(y1, cy1) - cy1 + 5 * (least(x2, cx2) - cx1) + 7 * (least(y2, cy2) - cy1)
ELSE 3 * (x1 - cx1) + y1 - cy1 + 5 * (x2 - cx1) + 7 * (y2 - cy1) END) AS BIGINT) AS places, 'line_bbox' AS classes, '' AS texts FROM m GROUP BY 1, 2"""
_WHOLE = """SELECT img_filename AS unique_key, img_filename, CAST(count(*) AS INT) AS n, CAST(sum(places) AS BIGINT) AS places, string_agg(DISTINCT class, ',' ORDER BY class) AS classes, string_agg(t, '|' ORDER BY o, line_pk) AS texts FROM ({}) GROUP BY img_filename"""
_LINE_ROWS = f"SELECT img_filename, 1 AS o, line_pk, coalesce(transcription, '') AS t, 'textline' AS class, {_SUM.format('polygon')} AS places FROM text_lines WHERE polygon IS NOT NULL"
_REGION_ROWS = "SELECT img_filename, 0 AS o, min(line_pk) AS line_pk, '' AS t, 'textregion' AS class, 2 * (3 * (min(bbox[1]) + max(bbox[3])) + min(bbox[2]) + max(bbox[4])) AS places FROM text_lines WHERE region_id IS NOT NULL GROUP BY img_filename, region_id"

for _name, _sql in (
    ("text_recognition__line_seg", _GAPPED.format(_NUMBERED.format("len(polygon)", _SUM.format("polygon")))),
    ("text_recognition__line_bbox", _GAPPED.format(_NUMBERED.format("4", _AROUND))),
    ("inst_seg_lines_within_regions", _INSIDE_SHAPES),
    ("line_od_within_regions", _INSIDE_BOXES),
    ("inst_seg_regions_and_lines", _WHOLE.format(f"{_LINE_ROWS} UNION ALL {_REGION_ROWS}")),
    ("inst_seg_lines", _WHOLE.format(_LINE_ROWS)),
    ("inst_seg_regions", _WHOLE.format(_REGION_ROWS)),
):
    _dataset(_name, _sql)


@query("""SELECT line_pk FROM text_lines WHERE len(polygon) >= 3""")
def line_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut from drawn page images; a line off the drawing would be missing."""
    from docflow.operators import crops

    lines = _lines(spark, sf_dir).where(F.size("polygon") >= 3).select("page", "line_pk", "polygon")
    small = lines.withColumn("polygon", F.transform("polygon", lambda p: F.struct((p["x"] / 10).cast("int").alias("x"), (p["y"] / 10).cast("int").alias("y"))))
    return crops.crop_images(crops.page_images(lines, width=400, height=800), small).where("image is not null").select("line_pk")


# --- sources and sinks -----------------------------------------------------------------------------------------------


def _fresh(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/docflow/{name}-{uuid.uuid4().hex}"


def _written_xml(spark: SparkSession, sf_dir: str) -> str:
    """Lines with text written as PAGE-XML; one without a region stands in the region ''. Beside them a file that isn't XML."""
    lines = _lines(spark, sf_dir).where("transcription is not null")
    lines = lines.withColumns({"line_id": F.col("line_pk").cast("string"), "transcription": F.trim("transcription"), "region_id": F.coalesce("region_id", F.lit("")), "polygon": F.coalesce("polygon", F.array())})
    path = _fresh(spark, "xml")
    sinks.write_page_xml(sinks.page_xml(lines, "page", "region_id", "line_pk"), f"{path}/pages")
    spark.range(1).select(F.lit("<PcGts><Page imageFile").alias("value")).write.text(f"{path}/broken")
    return path


_XML_LINES = """x AS (SELECT line_pk, img_filename AS page, coalesce(region_id, '') AS region_id, trim(transcription) AS t, polygon FROM text_lines WHERE transcription IS NOT NULL)"""


@query(f"""WITH {_XML_LINES} SELECT page, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(len(polygon)) AS BIGINT) AS n_points, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM x WHERE len(polygon) > 0 GROUP BY page""")
def page_xml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as PAGE-XML and read back (S5, S7, S9, K8); those without points are dropped."""
    back = pagexml.lines(pagexml.read_xml(spark, f"{_written_xml(spark, sf_dir)}/pages"))
    return back.groupBy(F.col("img_filename").alias("page")).agg(F.count("*").alias("n_lines"), F.sum(F.size("polygon")).alias("n_points"), F.sum(F.length("transcription")).alias("n_chars"))


@query(f"""WITH {_XML_LINES}, r AS (SELECT page, region_id, trim(string_agg(t, chr(10) ORDER BY line_pk), concat(chr(9), chr(10), chr(13), ' ')) AS transcription, min(line_pk) AS f, min(list_min(list_transform(polygon, lambda p: p.x))) AS x1, max(list_max(list_transform(polygon, lambda p: p.y))) AS y2 FROM x GROUP BY 1, 2)
SELECT concat(page, '_', printf('%04d', row_number() OVER (PARTITION BY page ORDER BY f) - 1)) AS unique_key, region_id, transcription, x1, y2 FROM r WHERE x1 IS NOT NULL""")
def page_xml_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions read back from PAGE-XML, whose reader trims texts (S6); those without points are dropped and not counted by the keys."""
    back = pagexml.regions(pagexml.read_xml(spark, f"{_written_xml(spark, sf_dir)}/pages"))
    return back.select("unique_key", "region_id", "transcription", G.corners(F.col("bbox"))[0].alias("x1"), G.corners(F.col("bbox"))[3].alias("y2"))


@query(f"""WITH {_XML_LINES}, r AS (SELECT page, region_id, coalesce(count_if(len(polygon) > 0), 0) AS n, min(line_pk) AS f FROM x GROUP BY 1, 2)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY f) - 1 AS INT) AS place, CASE WHEN n > 0 THEN region_id END AS region_id, CAST(n AS BIGINT) AS n_lines FROM r""")
def page_xml_regions_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region read back with its lines; one without points has only these."""
    back = pagexml.regions_with_lines(pagexml.read_xml(spark, f"{_written_xml(spark, sf_dir)}/pages"))
    return back.select(F.col("img_filename").alias("page"), F.col("place")[0].alias("place"), "region_id", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"))


@query(f"""WITH {_XML_LINES} SELECT CAST(line_pk AS VARCHAR) AS line_id, trim(t, concat(chr(9), chr(10), chr(11), chr(12), chr(13), ' ')) AS text FROM x""")
def page_xml_whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text within each line's element."""
    return pagexml.whole_texts(spark, f"{_written_xml(spark, sf_dir)}/pages").select("line_id", "text")


@query("SELECT CAST(1 AS BIGINT) AS n_unreadable")
def page_xml_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold no page; one was put there."""
    found = pagexml.unreadable(spark, _written_xml(spark, sf_dir)).where(F.col("path").contains("/broken/") & F.col("path").endswith(".txt"))
    return found.agg(F.count("*").alias("n_unreadable"))


@query(f"""WITH {_XML_LINES} SELECT CAST(line_pk AS VARCHAR) AS line_id, region_id, t AS transcription, list_min(list_transform(polygon, lambda p: p.x)) AS x1, list_max(list_transform(polygon, lambda p: p.y)) - list_min(list_transform(polygon, lambda p: p.y)) AS height FROM x WHERE len(polygon) > 0""")
def alto_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as ALTO and read back by block (K8)."""
    lines = _lines(spark, sf_dir).where("transcription is not null").where(F.size("polygon") > 0)
    lines = lines.withColumns({"line_id": F.col("line_pk").cast("string"), "transcription": F.trim("transcription"), "region_id": F.coalesce("region_id", F.lit(""))})
    path = _fresh(spark, "alto")
    sinks.write_page_xml(sinks.alto_xml(lines, "page", "region_id", "line_pk"), path, "altos")
    schema = "_ID string, TextLine array<struct<_ID: string, _HPOS: int, _HEIGHT: int, String: array<struct<_CONTENT: string>>>>"
    blocks = spark.read.format("xml").schema(schema).option("rowTag", "TextBlock").option("nullValue", "\x00").load(path)
    each = blocks.select(F.col("_ID").alias("region_id"), F.explode("TextLine").alias("l"))
    return each.select("l._ID", "region_id", F.col("l.String")[0]["_CONTENT"], "l._HPOS", "l._HEIGHT").toDF("line_id", "region_id", "transcription", "x1", "height")


@query("""WITH t AS (SELECT img_filename AS page, region_id, line_pk, coalesce(transcription, '') AS t, len(polygon) AS n FROM text_lines),
p AS (SELECT page, count(*) AS n_lines, string_agg(t, ' ' ORDER BY line_pk) AS text, count(DISTINCT region_id) AS n_regions, sum(CASE WHEN n > 0 THEN n + 1 ELSE 0 END) AS n_points FROM t GROUP BY page),
r AS (SELECT page, arg_min(x, f) AS first_text FROM (SELECT page, min(line_pk) AS f, string_agg(t, ' ' ORDER BY line_pk) AS x FROM t WHERE region_id IS NOT NULL GROUP BY page, region_id) GROUP BY page)
SELECT page AS path, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_regions AS BIGINT) AS n_regions, CAST(n_points AS BIGINT) AS n_points, text, first_text FROM p LEFT JOIN r USING (page)""")
def page_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with regions and lines as records, written as JSON and read back (S17, P29, K2); polygons are closed rings."""
    path = _fresh(spark, "pages")
    sinks.write_json(sinks.page_json(_lines(spark, sf_dir), "page", "region_id", "line_pk"), path)
    points = F.aggregate("lines", F.lit(0).cast("long"), lambda z, x: z + F.coalesce(F.size(x["polygon"]), F.lit(0)))
    back = files.read_pages(spark, path)
    return back.select("path", F.size("lines").cast("long").alias("n_lines"), F.size("regions").cast("long").alias("n_regions"), points.alias("n_points"), "text", F.get("regions", F.lit(0))["text"].alias("first_text"))


@query("""SELECT manifest_id, CAST(len(train) AS BIGINT) AS n_train, CAST(len(val) AS BIGINT) AS n_val, test[1] AS first_test FROM split_info""")
def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests written as one JSON value over several lines and read back."""
    path = _fresh(spark, "manifest")
    rows = table(spark, sf_dir, "split_info").select("manifest_id", "train", "val", "test")
    whole = rows.coalesce(1).select(F.to_json(F.struct("manifest_id", "train", "val", "test")).alias("x")).agg(F.collect_list("x").alias("xs"))  # a manifest has a row a batch
    whole.select(F.concat(F.lit("[\n"), F.array_join("xs", ",\n"), F.lit("\n]")).alias("value")).write.text(path)
    back = files.read_json(spark, path, "manifest_id bigint, train array<string>, val array<string>, test array<string>")
    return back.select("manifest_id", F.size("train").cast("long").alias("n_train"), F.size("val").cast("long").alias("n_val"), F.get("test", F.lit(0)).alias("first_test")).withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in ("n_train", "n_val")})


@query(r"""SELECT lower(md5(concat(text, chr(10)))) AS digest, CAST(count(*) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def whole_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as a file each, one that has its line breaks, and read back whole."""
    path = _fresh(spark, "texts")
    rows = table(spark, sf_dir, "documents").where("text is not null")
    sinks.write_text(rows.select("text"), path, "text", linebreak="\x00")
    back = files.read_texts(spark, path).select(F.explode(F.split("text", "\x00")).alias("text"), F.lit(1).alias("one"))
    # Each file ends with a separator, which leaves an empty text behind; there are as many of these as files.
    n_files = files.read_texts(spark, path).agg(F.count("*").alias("extra"))
    counted = back.groupBy("text").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n_files))
    return counted.select(F.md5(F.concat("text", F.lit("\n"))).alias("digest"), F.when(F.col("text") == "", F.col("n") - F.col("extra")).otherwise(F.col("n")).alias("n")).where("n > 0")


@query("""SELECT s.split, l.page, l.label FROM (SELECT img_filename AS page, string_agg(concat('0 ', CAST((bbox[1] + bbox[3]) / CAST(2 AS DOUBLE) / 1800 AS VARCHAR), ' ', CAST((bbox[2] + bbox[4]) / CAST(2 AS DOUBLE) / 2400 AS VARCHAR), ' ', CAST((bbox[3] - bbox[1]) / CAST(1800 AS DOUBLE) AS VARCHAR), ' ', CAST((bbox[4] - bbox[2]) / CAST(2400 AS DOUBLE) AS VARCHAR)), chr(10) ORDER BY line_pk) AS label FROM text_lines GROUP BY 1) l
JOIN (WITH p AS (SELECT DISTINCT img_filename AS page FROM text_lines), n AS (SELECT page, row_number() OVER (ORDER BY md5(concat('42|', page)), page) AS r, count(*) OVER () AS t FROM p), c AS (SELECT *, CAST(ceil(t * CAST(0.1 AS DOUBLE)) AS BIGINT) AS k FROM n)
SELECT page, CASE WHEN r <= k THEN 'test' WHEN r <= k + ceil((t - k) * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM c) s USING (page)""")
def yolo_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files and configuration written in the training layout and read back (K5)."""
    lines = _lines(spark, sf_dir).select("page", "line_pk", "box", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
    split = splits.mixed(lines.select("page").distinct(), "page")
    path = _fresh(spark, "yolo")
    sinks.write_yolo_files(sinks.yolo_labels(lines, "page", "line_pk").join(split.select("page", "split"), "page").withColumnRenamed("page", "key"), path, ["line"])
    back = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("label"))
    parts = F.split(F.try_url_decode("path"), "/")
    return back.select(F.element_at(parts, -3).alias("split"), F.regexp_replace(F.element_at(parts, -1), r"\.txt$", "").alias("page"), "label")


@query("""SELECT line_pk, bbox[1] AS x1, transcription FROM text_lines""")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON lines and read back."""
    path = _fresh(spark, "json")
    sinks.write_json(_lines(spark, sf_dir).select("line_pk", "box", "transcription"), path)
    back = files.read_ndjson(spark, path, "line_pk bigint, box array<int>, transcription string")
    return back.select("line_pk", G.corners(F.col("box"))[0].alias("x1"), "transcription")


@query("""SELECT volume_id, img_volume, source FROM volumes UNION ALL SELECT volume_id + 100000, img_volume, NULL FROM volumes""")
def united_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in folders, one of them written with a folder a source, and read as one."""
    path = _fresh(spark, "tables")
    volumes = table(spark, sf_dir, "volumes").select("volume_id", "img_volume", "source")
    sinks.write_pages(volumes.withColumn("page", F.col("source")), f"{path}/a", "page")
    volumes.select((F.col("volume_id") + 100_000).alias("volume_id"), "img_volume").write.parquet(f"{path}/b")
    return files.read_tables(spark, path, "volume_id bigint, img_volume string, source string")


@query("""SELECT volume_id, source, year_from FROM volumes""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as CSV and read back (K4)."""
    path = _fresh(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "volumes").select("volume_id", "source", "year_from"), path)
    return spark.read.schema("volume_id bigint, source string, year_from int").option("header", "true").csv(path)


@query(r"""SELECT trim(transcription) AS line, CAST(count(*) AS BIGINT) AS n FROM text_lines WHERE transcription IS NOT NULL GROUP BY 1""")
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as text files and read back without white space around them."""
    path = _fresh(spark, "text")
    sinks.write_text(_lines(spark, sf_dir).where("transcription is not null"), path, "transcription")
    return files.read_lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT table_name AS stem FROM information_schema.tables""")
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the data folder by the suffix of its files, those in several parts once."""
    return files.list_tables(spark, sf_dir)


@query()
def pipeline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of lines within regions by the stub backend over documents as images (D1 to D3, S16); not a recognition result."""
    from docflow.plans import pipelines

    config = pipelines.parse_config("pipeline: region_od__line_od__ocr\nbackends:\n  region: stub\n  line: stub\n  ocr: stub\n")
    images = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("page"), F.encode("text", "UTF-8").alias("image"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
    return pipelines.run_config(images, config)
