from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from docflow.functions import geometry as G
from docflow.functions import names, ratios as R
from docflow.functions.text import nfc, nfd


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def box(*v):
    return F.array(*(F.lit(x) for x in v))


def test_ratio_example(spark) -> None:
    rows = spark.createDataFrame([(1, 5), (1, 100)], "a long, b long")
    total = rows.agg(R.total(R.ratio(F.col("a"), F.col("b"))).alias("r")).select("r.a", "r.b", R.value(F.col("r")).alias("v"), R.fraction(F.col("r")).alias("s")).first()
    assert tuple(total) == (2, 105, 2 / 105, "2/105")
    assert one(spark, R.value(R.ratio(3, 0)), R.value(R.parse(F.lit("3/4")))) == (0.0, 0.75)
    assert rows.where("false").agg(R.total(R.ratio(F.col("a"), F.col("b"))).alias("r")).select(R.fraction(F.col("r"))).first()[0] == "0/0"


def test_text_metrics(spark) -> None:
    m = one(spark, R.ocr_metrics(F.lit("hålla ut och se"), F.lit("halla ut och  se se")).alias("m"))["m"]
    assert tuple(m["wer"]) == (2, 4) and tuple(m["bow_hits"]) == (3, 4) and tuple(m["bow_extras"]) == (2, 5) and m["cer"]["b"] == 15
    lines = [("", ""), ("abc", ""), ("", "abcd"), ("ab", "abcd")]
    rows = spark.createDataFrame(lines, "t string, r string")
    got = [tuple(r["m"]["cer"]) for r in rows.select(R.line_metrics(F.col("t"), F.col("r")).alias("m")).collect()]
    assert got == [(0, 0), (3, 3), (4, 4), (2, 4)]
    by_truth = [tuple(r["m"]["cer"]) for r in rows.select(R.line_metrics(F.col("t"), F.col("r"), "reference").alias("m")).collect()]
    assert by_truth == [(0, 0), (3, 3), (4, 4), (2, 2)]


def test_bins(spark) -> None:
    edges = [tuple(one(spark, G.quantise(F.lit(v), F.lit(500)), G.dequantise(G.quantise(F.lit(v), F.lit(500)), F.lit(500)))) for v in (-3, 0, 499, 500, 9999)]
    assert edges == [(0, 0.25), (0, 0.25), (998, 499.25), (999, 499.75), (999, 499.75)]


def test_boxes(spark) -> None:
    a, b = box(0, 0, 10, 10), box(5, 0, 15, 10)
    got = one(spark, G.iou(a, b), G.coverage(a, b), G.merge(a, b), G.clip(a, b), G.clip(a, box(50, 50, 60, 60)), G.iou(box(1, 1, 1, 1), box(1, 1, 1, 1)), G.coverage(box(1, 1, 1, 1), a))
    assert got == (50 / 150, 0.5, [0, 0, 15, 10], [5, 0, 10, 10], [0, 0, 10, 10], None, 0.0)
    assert one(spark, G.from_xywh(G.to_xywh(b)), G.shift_box(a, F.lit(2), F.lit(3))) == ([5, 0, 15, 10], [2, 3, 12, 13])


def test_polygons(spark) -> None:
    p = G.parse_points(F.lit(" 1,2 3,4  5,0 "))
    got = one(spark, G.polygon_bbox(p), G.format_points(p), F.size(G.close_ring(p)), G.format_points(G.bbox_polygon(box(1, 2, 3, 4))), G.location_tokens(box(1, 22)))
    assert got == ([1, 0, 5, 4], "1,2 3,4 5,0", 4, "1,2 1,4 3,4 3,2", "<loc_1><loc_22>")
    flat = F.array(*(F.lit(float(v)) for v in (1, 2, 3, 4, 5)))
    assert [tuple(q) for q in one(spark, G.pairs(flat))[0]] == [(1.0, 2.0), (3.0, 4.0)]
    assert one(spark, G.pairs(F.array(F.lit(1.0))), G.pairs(F.slice(flat, 1, 0))) == ([], [])


def test_names(spark) -> None:
    spellings = ["Åby_häradsrätt_A0000012_00007", "ABY-HARADSRATT-a0000012-7", "%C3%85by_h%C3%A4radsr%C3%A4tt_A0000012_00007.jpg", " Aaby häradsrätt А0000012 00007 (1)", unicodedata.normalize("NFD", "Åby_häradsrätt_A0000012_0000007 - kopia"), "Åby__häradsrätt.A00​00012_00007~1"]
    rows = spark.createDataFrame([(f"{s}_tr_03",) for s in spellings], "k string").select(names.region_key(F.col("k")).alias("k"), names.volume_of(names.fold_name(F.col("k"))).alias("v")).distinct()
    assert [tuple(r) for r in rows.collect()] == [("aby_haradsratt_a0000012/7/3", "aby_haradsratt_a0000012")]
    others = spark.createDataFrame([("IMG_000012_r1",), ("",), (None,), ("100%_sure",)], "k string").select(names.region_key(F.col("k")).alias("k"))
    assert [r[0] for r in others.collect()] == [None] * 4
    sides = spark.createDataFrame([(x,) for x in ("TRAIN", " Validation", "te​st", "dev", "x", None)], "s string").select(names.split_name(F.col("s")))
    assert [r[0] for r in sides.collect()] == ["train", "val", "test", "val", None, None]


def test_normal_forms(spark) -> None:
    rows = spark.createDataFrame([("Björkö",), (unicodedata.normalize("NFD", "Björkö"),), (None,), ("",)], "t string").select(nfc(F.col("t")).alias("c"), nfd(F.col("t")).alias("d"))
    assert [r["c"] for r in rows.collect()] == ["Björkö", "Björkö", None, ""]
    assert {r["d"] for r in rows.collect()} == {unicodedata.normalize("NFD", "Björkö"), None, ""}
