from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from docflow.operators import layout, metrics, records, splits
from docflow.plans import pipelines
from docflow.sources import files, pagexml, sinks
from docflow.streaming import pages

NS = 'xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"'
PAGE = f"""<?xml version="1.0" encoding="UTF-8"?>
<PcGts {NS}><Metadata><Creator>x</Creator></Metadata><Page imageFilename="p1.jpg" imageWidth="100" imageHeight="100">
<TextRegion id="r1"><Coords points="0,0 0,9 9,9 9,0"/>
  <TextLine id="l1"><Coords points="1,1 1,2 8,2"/><TextEquiv><Unicode>första &amp; raden</Unicode></TextEquiv></TextLine>
  <TextLine id="l2"><Coords points="1,3 1,4 8,4"/><TextEquiv><Unicode></Unicode></TextEquiv></TextLine>
  <TextLine id="l3"><Coords points="1,5 1,6 8,6"/></TextLine>
  <TextLine id="l4"><Coords points="1,5.5 1,6 8,6"/><TextEquiv><Unicode>trasig</Unicode></TextEquiv></TextLine>
  <TextEquiv><Unicode>allt</Unicode></TextEquiv>
  <TextRegion id="r1a"><Coords points="2,2 2,3 3,3"/><TextLine id="l6"><Coords points="2,2 2,3 3,3"/><TextEquiv><Unicode>inre</Unicode></TextEquiv></TextLine><TextEquiv><Unicode>i</Unicode></TextEquiv></TextRegion>
</TextRegion>
<TextRegion id="r2"><Coords points="0,20 0,29 9,29"/><TextLine id="l5"><Coords points="1,21 1,22 8,22"/><TextEquiv><Unicode>kvar</Unicode></TextEquiv></TextLine></TextRegion>
</Page></PcGts>"""


def test_page_xml(spark, tmp_path) -> None:
    folder = tmp_path / "vol" / "page_xmls"
    folder.mkdir(parents=True)
    (folder / "p1.xml").write_text(PAGE)
    (folder / "empty.xml").write_text(f'<PcGts {NS}><Page imageFilename="empty.jpg"></Page></PcGts>')
    (folder / "bad.xml").write_text("<PcGts><Page imageFile")
    read = pagexml.read_xml(spark, str(tmp_path))
    lines = sorted((r["unique_key"], r["region_id"], r["line_id"], r["transcription"], r["bbox"]) for r in pagexml.lines(read).collect())
    assert lines == [("p1_0000", "r1", "l1", "första & raden", [1, 1, 8, 2]), ("p1_0001", "r1", "l2", "", [1, 3, 8, 4]), ("p1_0002", "r1a", "l6", "inre", [2, 2, 3, 3]), ("p1_0003", "r2", "l5", "kvar", [1, 21, 8, 22])]
    regions = sorted((r["unique_key"], r["region_id"], r["transcription"]) for r in pagexml.regions(read).collect())
    assert regions == [("p1_0000", "r1", "allt"), ("p1_0001", "r1a", "i")]
    both = {tuple(r["place"]): (r["region_id"], len(r["lines"])) for r in pagexml.regions_with_lines(read).collect()}
    assert both == {(0,): ("r1", 2), (0, 0): ("r1a", 1), (1,): (None, 1)}
    assert [os.path.basename(r["path"]) for r in pagexml.unreadable(spark, str(tmp_path)).collect()] == ["bad.xml"]


def test_regions_at_any_depth(spark, tmp_path) -> None:
    """Six levels: counted from the files they are all read, with the usual schema they are an error."""
    line = '<TextLine id="l{0}"><Coords points="1,1 1,2 8,2"/><TextEquiv><Unicode>{0}</Unicode></TextEquiv></TextLine>'
    inner = "".join(f'<TextRegion id="r{k}"><Coords points="0,0 0,9 9,9"/>' + line.format(k) for k in range(6)) + "</TextRegion>" * 6
    (tmp_path / "deep.xml").write_text(f'<PcGts {NS}><Page imageFilename="deep.jpg">{inner}<TextRegion id="e"/></Page></PcGts>')
    assert pagexml.nesting(spark, str(tmp_path)) == 6
    assert sorted(r["transcription"] for r in pagexml.lines(pagexml.read_xml(spark, str(tmp_path), None)).collect()) == list("012345")
    with pytest.raises(Exception, match="nested deeper"):
        pagexml.lines(pagexml.read_xml(spark, str(tmp_path))).collect()


def test_whole_text_of_lines(spark, tmp_path) -> None:
    words = "<Word><TextEquiv><Unicode>en</Unicode></TextEquiv></Word><Word><TextEquiv><Unicode>&amp;lt;</Unicode></TextEquiv></Word>"
    (tmp_path / "w.xml").write_text(f'<PcGts {NS}><Page><TextRegion id="r"><TextLine id="l0"/><TextLine id="l1">\n{words}<!-- <TextLine> --> <TextEquiv><Unicode>en &lt;</Unicode></TextEquiv></TextLine><TextLine id="l2"/></TextRegion></Page></PcGts>')
    assert [tuple(r)[1:] for r in pagexml.whole_texts(spark, str(tmp_path)).collect()] == [("l1", "en&lt; en <")]


def test_corrupt_tables(spark, tmp_path) -> None:
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "a"))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.parquet").write_bytes(b"PAR1 cut")
    assert [os.path.basename(r["path"]) for r in files.corrupt_tables(spark, str(tmp_path)).collect()] == ["x.parquet"]
    assert files.read_tables(spark, str(tmp_path), "id bigint", skip_corrupt=True).count() == 3
    with pytest.raises(Exception):
        files.read_tables(spark, str(tmp_path), "id bigint").count()


def test_files(spark, tmp_path) -> None:
    for name in ("a/images/2.jpg", "a/images/1.JPG", "b/3.Jpg", "b/4.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    assert [os.path.basename(r["path"]) for r in files.list_files(spark, str(tmp_path)).collect()] == ["1.JPG", "2.jpg"]
    assert sorted((r["volume"], r["img_filename"], bytes(r["image"])) for r in files.read_images(spark, str(tmp_path)).collect()) == [("images", "1", b"x"), ("images", "2", b"x")]
    (tmp_path / "t.json").write_text('{\n"regions": [], "text": "å",\n "path": "p"}')
    assert files.read_pages(spark, str(tmp_path / "t.json"), multi_line=True).first()["text"] == "å"
    (tmp_path / "t.txt").write_text(" a \n\tb\n")
    assert [r["line"] for r in files.read_lines(spark, str(tmp_path / "t.txt")).collect()] == ["a", "b"]
    assert files.read_texts(spark, str(tmp_path / "t.txt")).first()["text"] == " a \n\tb\n"


def test_sinks(spark, tmp_path) -> None:
    boxes = spark.createDataFrame([("p", 1, [0, 0, 50, 100], 100, 200), ("p", 2, [10, 10, 10, 10], 100, 200)], "page string, k int, box array<int>, width int, height int")
    assert sinks.yolo_labels(boxes, "page", "k").first()["label"] == "0 0.25 0.25 0.5 0.5\n0 0.1 0.05 0.0 0.0"
    polygons = spark.createDataFrame([("p", 1, [(1, 2), (3, 4)], 3, 7)], "page string, k int, polygon array<struct<x:int,y:int>>, width int, height int")
    assert sinks.yolo_polygons(polygons, "page", "k").first()["label"] == "0 0.333333 0.285714 1.000000 0.571429"
    assert "nc: 1" in sinks.yolo_config(["line"], "/x")
    labels = spark.createDataFrame([("train", "å_1", "0 1 1 1 1"), ("val", "b", "")], "split string, key string, label string")
    for k, prefix in enumerate(("", "file:", "file://")):
        sinks.write_yolo_files(labels, f"{prefix}{tmp_path}/y{k}", ["line"])
        assert (tmp_path / f"y{k}" / "train" / "labels" / "å_1.txt").read_text() == "0 1 1 1 1" and (tmp_path / f"y{k}" / "val" / "labels" / "b.txt").read_text() == ""
        assert "names: ['line']" in (tmp_path / f"y{k}" / "config.yaml").read_text()
    rows = spark.createDataFrame([("a", 1, "train"), ("b", 2, "val")], "page string, n int, split string")
    sinks.write_pages(rows, str(tmp_path / "p"))
    sinks.write_split(rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == spark.read.parquet(str(tmp_path / "s")).where("split = 'val'").count() * 2
    assert sorted(os.listdir(tmp_path / "s"))[-2:] == ["split=train", "split=val"]


def test_reading_order(spark) -> None:
    boxes = spark.createDataFrame([("p", 1, [0, 0, 10, 10]), ("p", 2, [5, 8, 15, 18]), ("p", 3, [0, 16, 10, 26]), ("p", 4, [100, 0, 110, 10])], "page string, k int, box array<int>")
    bands = {r["k"]: (r["band"], r["position"]) for r in layout.order_bands(boxes, "page", "k").collect()}
    assert bands == {1: (0, 0), 2: (0, 1), 4: (0, 2), 3: (1, 3)}  # 16 is far from the band's first box at 0, though near 8
    columns = {r["k"]: r["position"] for r in layout.order_columns(boxes, "page", "k").collect()}
    assert columns == {1: 0, 3: 1, 4: 2, 2: 3}
    placed = boxes.withColumns({"printspace": F.array(*map(F.lit, (0, 5, 50, 30))), "two_pages": F.lit(False)})
    order = {r["k"]: r["position"] for r in layout.order_with_margins(placed, "page", "k").collect()}
    assert order == {1: 0, 2: 1, 3: 2, 4: 3}
    assert layout.order_bands(boxes.where("false"), "page", "k").count() == 0


def test_splits(spark) -> None:
    pages_ = spark.range(9644).withColumnRenamed("id", "page")
    counts = {r["split"]: r["count"] for r in splits.mixed(pages_, "page").groupBy("split").count().collect()}
    assert counts == {"train": 7811, "val": 868, "test": 965}  # the published sizes
    again = splits.mixed(pages_.repartition(7), "page").where("split = 'val'")
    assert again.join(splits.mixed(pages_, "page").where("split = 'val'"), "page").count() == 868
    three = {r["split"]: r["count"] for r in splits.by_counts(pages_.limit(101), "page").groupBy("split").count().collect()}
    assert three == {"train": 70, "val": 15, "test": 16}
    assert splits.mixed(pages_.where("false"), "page").count() == 0


def test_records(spark) -> None:
    rows = spark.createDataFrame([(k,) for k in range(10)], "k int")
    assert [r["k"] for r in records.select_rows(rows, ["k"], 2, 8, 3).collect()] == [2, 5]
    assert [r["k"] for r in records.select_rows(rows, ["k"], 7).collect()] == [7, 8]
    loss = spark.createDataFrame([("m", 1, 0.5), ("m", 2, 0.3), ("m", 3, 0.3), ("m", 4, None), ("n", 7, None)], "model string, step int, loss double")
    assert {r["model"]: r["step"] for r in records.best_checkpoint(loss, "model", "step", "loss").collect()} == {"m": 2, "n": 7}
    report = records.pairing_report(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",), ("c",)], "k string"), "k").first()
    assert tuple(report) == (2, 2, 1, False)


def test_detection_scores(spark) -> None:
    truth = spark.createDataFrame([("p", 1, [0, 0, 10, 10]), ("p", 2, [50, 50, 60, 60]), ("q", 3, [0, 0, 10, 10])], "page string, k long, box array<int>")
    found = spark.createDataFrame([("p", 1, [0, 0, 10, 9]), ("p", 2, [90, 90, 99, 99])], "page string, k long, box array<int>")
    got = metrics.detection_scores(truth, found, "page").first()
    assert (got["ref_precision"], got["ref_recall"], got["ref_f1"], got["precision"], got["recall"]) == (1.0, 1 / 3, 0.5, 0.5, 1 / 3)
    pairs = metrics.match_boxes(truth, found, "page", "k").collect()
    assert [(r["truth_key"], r["read_key"]) for r in pairs] == [(1, 1)]
    covered = {r["page"]: (r["covered"], r["area"]) for r in metrics.box_coverage(truth, found, "page").collect()}
    assert covered == {"p": (90, 200), "q": (0, 100)}


def test_pipelines(spark) -> None:
    images = spark.createDataFrame([("p", bytearray("text å".encode()), 100, 200), ("q", bytearray(b"\xff"), 100, 1)], "page string, image binary, width int, height int")
    for name, steps in pipelines.PIPELINES.items():
        out = pipelines.run(images, name, {**dict.fromkeys(steps, "stub"), "ocr": "stub"}).collect()
        assert len(out) == 2 ** len(steps) and all(r["text"] == "text å" and r["page"] == "p" for r in out)
    assert pipelines.parse_config("pipeline: line_od__ocr # x\nbackends:\n  line: stub\n  ocr: 'stub'\n") == {"pipeline": "line_od__ocr", "backends": {"line": "stub", "ocr": "stub"}}


def test_stream_resumes(spark, tmp_path) -> None:
    landing, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    schema = "page string, n long"
    step = lambda df: df.groupBy("page").agg(F.sum("n").alias("n"))
    for batch in (1, 2):
        spark.createDataFrame([("a", batch), ("b", 5)], schema).coalesce(1).write.mode("append").parquet(landing)
        pages.process_new(spark, landing, schema, step, out, state).awaitTermination()
    assert sorted((r["page"], r["n"]) for r in spark.read.parquet(out).collect()) == [("a", 1), ("a", 2), ("b", 5), ("b", 5)]
    events = spark.sql("SELECT timestamp'2020-01-01 00:00:10' AS ts, 'a' AS kind UNION ALL SELECT timestamp'2020-01-01 00:00:50', 'a'")
    assert [r["n"] for r in pages.windowed_counts(events, "ts", "kind", "1 minute", "1 minute").collect()] == [2]


def test_png_and_crops(spark) -> None:
    import struct
    import zlib

    import numpy as np

    from docflow.functions import png
    from docflow.operators import crops

    rng = np.random.default_rng(1)
    for shape in ((5, 7), (4, 6, 3), (3, 3, 4)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        assert np.array_equal(png.decode(png.encode(image)), image)
    # One row for each of the format's filters over a known picture of 2 channels' width 3.
    want = rng.integers(0, 256, (5, 3, 3)).astype(np.uint8)
    flat, rows = want.reshape(5, 9).astype(int), []
    for y, kind in enumerate(range(5)):
        up = flat[y - 1] if y else np.zeros(9, int)
        left, corner = np.r_[0, 0, 0, flat[y][:-3]], np.r_[0, 0, 0, up[:-3]]
        guess = left + up - corner
        paeth = np.where((abs(guess - left) <= abs(guess - up)) & (abs(guess - left) <= abs(guess - corner)), left, np.where(abs(guess - up) <= abs(guess - corner), up, corner))
        rows.append(bytes([kind]) + ((flat[y] - [0, left, up, (left + up) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes())
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + b"\0\0\0\0"
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert np.array_equal(png.decode(data), want)

    image = np.arange(100, dtype=np.uint8).reshape(10, 10)
    cut = crops.crop(image, np.array([[2, 3], [2, 5], [6, 3]]))
    assert cut.shape == (3, 5) and cut[0, 0] == 32 and cut[2, 4] == 255
    pages_ = spark.createDataFrame([("p", bytearray(png.encode(image))), ("q", bytearray(b"x")), ("r", None)], "page string, image binary")
    polygons = spark.createDataFrame([("p", 1, [(0, 0), (0, 3), (3, 3), (3, 0)]), ("p", 2, [(50, 50), (50, 60), (60, 60)]), ("q", 3, [(0, 0), (0, 1), (1, 1)]), ("r", 4, None)], "page string, k int, polygon array<struct<x:int,y:int>>")
    got = {r["k"]: r["image"] for r in crops.crop_images(pages_, polygons).collect()}
    assert np.array_equal(png.decode(bytes(got[1])), image[:4, :4]) and got[2] is got[3] is got[4] is None


def test_masks_of_pages(spark) -> None:
    """A page longer than a batch, one whose name is null, one with reads only, and points of no page."""
    square = lambda x, y: [(x, y), (x, y + 9), (x + 9, y + 9), (x + 9, y)]
    rows = [("long", k, side, square(20 * k, 5 + (not side))) for k in range(40) for side in (True, False)]
    rows += [(None, 1, True, square(0, 0)), (None, 2, False, square(1, 0)), ("reads", 1, False, square(0, 0)), ("short", 1, True, [(0, 0), (1, 1)]), ("short", 2, True, None)]
    polygons = spark.createDataFrame(rows, "page string, k long, is_truth boolean, polygon array<struct<x int, y int>>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {(r["page"], r["truth_key"], r["read_key"]): r["iou"] for r in metrics.match_masks(polygons, "page").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(found) == {("long", k, k) for k in range(40)} | {(None, 1, 2), ("reads", None, 1)}
    assert found["reads", None, 1] is None and all(abs(v - 9 / 11) < 1e-6 for k, v in found.items() if k[0] != "reads")


def test_listing_is_whole(spark, tmp_path) -> None:
    """Names that a scan passes over are files too, and a table in parts is one table."""
    for name in ("t/_a.jpg", "t/.b.jpg", "t/.jpg", "t/c.jpg", "t/_d/e.jpg", "t/f/.g/_h/i.jpg", "t/f/j/_k.JPG", "t/f/_l.txt", "t/_m=1/n.jpg"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"xyz")
    found = files.list_files(spark, str(tmp_path / "t")).collect()
    assert [r["path"].split("/t/")[1] for r in found] == [".b.jpg", "_a.jpg", "_d/e.jpg", "_m=1/n.jpg", "c.jpg", "f/.g/_h/i.jpg", "f/j/_k.JPG"]
    whole = {r["path"]: (r["length"], r["modificationTime"]) for r in found}
    assert all(n == 3 for n, _ in whole.values()) and max(t for _, t in whole.values()) - min(t for _, t in whole.values()) < datetime.timedelta(minutes=5)
    spark.range(9).repartition(3).write.parquet(str(tmp_path / "tables/parts.parquet"))
    for name in ("_one", "two.v1"):
        (tmp_path / f"tables/{name}.parquet").write_bytes(b"x")
    spark.range(1).write.parquet(str(tmp_path / "tables/other"))
    assert sorted(r["stem"] for r in files.list_tables(spark, str(tmp_path / "tables")).collect()) == ["_one", "parts", "two.v1"]
