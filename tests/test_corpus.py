from __future__ import annotations

import json
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa

from docflow.operators import archive, nested
from docflow.plans import corpus

FILES = "file_id long, file_path string, unique_key string, body string, n_bytes long, record string, part string"


def files(spark):
    rows = [
        (5, "a", "ö_1", "0 0.5 0.25 1 1\n0 1 1 1 1", 3), (2, "b", "ö_1", "﻿0 1.0 1 1e0 1\r\n0  5e-1 0.250 1 1\n\n", None), (3, "c", "ö_1", "0 0.5 0.25 1 1", 1),
        (7, "d", "o_2", "", 0), (8, "e", "o_2", " \n\n", 0), (9, "f", "o_2", None, None), (10, "g", None, "0 1 1 1 1", 1), (11, "h", None, "0 1 1 1 1.0", 1), (12, "i", "o_3", "0 1 1 1 1", 1), (13, None, "o_4", "junk x\n" * 50_000, 1), (14, "k", "o_5", "0 0 0 -0.0 1", 1), (15, "l", "o_5", "0 0 0 0 1", 1),
    ]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], FILES)


def test_copies(spark) -> None:
    index = archive.record_index(files(spark))
    assert sorted(r[0] for r in archive.copies(index).collect()) == [5, 8, 11, 15]
    assert index.count() == 11 and index.where("file_id = 9").count() == 0
    assert archive.copies(archive.record_index(files(spark).where("false"))).count() == 0
    assert archive.copies(archive.record_index(files(spark).toDF("file_id", "file_path", "unique_key", "body", "n_bytes", "BODY", "stored_id"))).count() == 4


def test_round_trip(spark, tmp_path) -> None:
    source = files(spark)
    bodies = {r["file_id"]: r["body"] for r in source.collect()}
    for k, (size, most, tasks) in enumerate(((1 << 20, 100, None), (40, 100, 3), (1 << 20, 2, 1))):
        container = archive.write(archive.pack(source, size, most, tasks), str(tmp_path / str(k)))
        back = {r["file_id"]: (bytes(r["bytes"]).decode(), r["intact"]) for r in archive.restore(container.blocks).collect()}
        assert set(back) == {2, 3, 7, 10, 12, 13, 14} and all(v == (bodies[k], True) for k, v in back.items())
        blocks = container.blocks.collect()
        assert len(blocks) == len({r["block_id"] for r in blocks})
        assert all(r["crc32"] == zlib.crc32(bytes(r["payload"])) and r["n_bytes"] == len(r["payload"]) and r["n_files"] == len(r["file_ids"]) <= most for r in blocks)
        resolved = {r["file_id"]: r for r in archive.resolve(container).collect()}
        assert set(resolved) == {i for i, b in bodies.items() if b is not None}
        assert {i: r["stored_id"] for i, r in resolved.items() if r["stored_id"] != i} == {5: 2, 8: 7, 11: 10, 15: 14}
        payloads = {r["block_id"]: bytes(r["payload"]) for r in blocks}
        for i, r in resolved.items():
            at = payloads[r["block_id"]][r["offset"] : r["offset"] + r["stored_length"]]
            assert at.decode() == bodies[r["stored_id"]] and zlib.crc32(at) == r["stored_crc32"]
            assert (r["length"], r["crc32"]) == (len(bodies[i].encode()), zlib.crc32(bodies[i].encode())) and r["file_path"] == source.where(f"file_id = {i}").first()["file_path"]
        assert [bytes(r["bytes"]).decode() for r in archive.lookup(container.blocks, [3]).collect()] == [bodies[3]]
    empty = archive.pack(source.where("false"))
    assert empty.blocks.count() == 0 and archive.resolve(empty).count() == 0


def test_repeated_rows(spark) -> None:
    twice = files(spark).union(files(spark))
    container = archive.pack(twice)
    assert archive.restore(container.blocks).count() == 7 and container.aliases.count() == 4 and archive.resolve(container).count() == 11


def test_blocks_are_full(spark) -> None:
    rows = spark.range(5000).selectExpr("id as file_id", "concat('p', id) as file_path", "concat('k', id) as unique_key", "concat(repeat('0 1 1 1 1\n', cast(id % 7 as int)), id) as body")
    sizes = [r["n_bytes"] for r in archive.pack(rows, 4000, tasks=3).blocks.orderBy("block_id").collect()]
    assert sum(n < 4000 - 80 for n in sizes) <= 3 and max(sizes) <= 4000


def test_a_record_of_a_third_of_all_files(spark) -> None:
    rows = spark.range(3000).selectExpr("id as file_id", "concat('p', id) as file_path", "if(id % 3 = 0, 'k', concat('k', id)) as unique_key", "if(id % 6 = 0, '0 1 1 1 1', '0 1.0 1 1 1 ') as body")
    container = archive.pack(rows)
    assert container.aliases.count() == 999 and archive.resolve(container).where("stored_id = 0").count() == 1000


def brute(payload: str | None) -> list[tuple]:
    try:
        root = json.loads(payload)
    except (TypeError, ValueError):
        return []
    out = []

    def objects(v):
        return [(i, x) for i, x in enumerate([v] if isinstance(v, dict) else v if isinstance(v, list) else []) if isinstance(x, dict)]

    def points(v) -> list[int]:
        if isinstance(v, dict):
            v = v["points"] if "points" in v else v
        if isinstance(v, dict):
            return [0] if "x" in v else []
        if isinstance(v, str):
            return list(range(len(v.split())))
        return [i for i, p in enumerate(v) if isinstance(p, (list, dict, str))] if isinstance(v, list) else []

    def walk(o, prefix) -> None:
        for i, r in objects(o.get("regions")):
            path = f"{prefix}{i}"
            out.append((path, -1, -1))
            out.extend((path, -1, k) for k in points(r.get("polygon")))
            for n, line in objects(r.get("lines")):
                out.append((path, n, -1))
                out.extend((path, n, k) for k in points(line.get("polygon")))
            walk(r, path + ".")

    def page(o):
        if "Page" in o:
            found = [x for _, x in objects(o["Page"])]
            return found[0] if found else {}
        for k, v in o.items():
            if isinstance(v, dict) and k != "regions" and (p := page(v)):
                return p
        return {}

    if isinstance(root, dict):
        found = page(root)
        walk(found or root, "")
    return out


def test_flattening_against_brute_force() -> None:
    rng = random.Random(3)

    def polygon():
        return rng.choice([None, [], [[1, 2], [3, 4]], [["1", "2"], None, ["3", "4"]], [{"x": 1, "y": 2}], {"points": [{"x": 1, "y": 2}, {"x": 3, "y": -4.5}]}, {"points": "1,2 3,4\n 5,6"}, {"points": None}, "7,8 9,10", "", {"x": 5, "y": 6}])

    def line():
        return rng.choice([None, {}, {"polygon": polygon(), "line_id": 'a"\\b{[,', "words": [{"polygon": [[1, 1]]}]}, {"line_id": "ö ", "polygon": polygon()}, "x", 5])

    def region(depth):
        r = {"region_id": rng.choice(["r1", None, 'q"]}', "\\"]), "polygon": polygon(), "custom": {"regions": [{"polygon": [[0, 0]]}]}}
        if rng.random() < 0.8:
            r["lines"] = rng.choice([line(), [line() for _ in range(rng.randint(0, 4))]])
        if depth < 4 and rng.random() < 0.4:
            r["regions"] = rng.choice([region(depth + 1), [rng.choice([None, region(depth + 1)]) for _ in range(rng.randint(0, 3))]])
        return r

    payloads = []
    for _ in range(400):
        body = {"imageFilename": "x\\", "regions": rng.choice([None, region(0), [rng.choice([None, region(0), 3, "s"]) for _ in range(rng.randint(0, 4))]])}
        shape = rng.choice([{"Page": body}, {"PcGts": {"Metadata": {"Creator": None}, "Page": body}}, {"Page": [body]}, {"Page": [None, body]}, body, [1, 2], 5, "s", None, {}])
        text = json.dumps(shape, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        payloads.append(rng.choice([text, text, text, text, text[: len(text) // 2], text + "}", " " + text]))
    payloads += [None, "", "<xml/>", "{'a': 1}"]
    want = sorted((k, *row) for k, p in enumerate(payloads) for row in brute(p))
    for values in (False, True):
        got = [tuple(r.values())[:4] for b in nested.flatten(pa.array(payloads, pa.large_string()), pa.array(range(len(payloads))), values) for r in b.to_pylist()]
        assert sorted(got) == want


def is_json(text: str) -> bool:
    def no_constant(name: str):
        raise ValueError(name)

    try:
        json.loads(text, parse_constant=no_constant)
    except ValueError:
        return False
    return True


def accepted(payloads: list[str]) -> list[bool]:
    raw = pa.array(payloads, pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)
    return nested.Values(np.frombuffer(raw.buffers()[2] or b"", np.uint8), offsets).good.tolist()


def test_what_is_json() -> None:
    """Written cases and random damage to JSON texts in one buffer, against a parser."""
    cases = ["{}", "[]", "0", "-0.5e+3", "01", "+1", ".5", "1.", "1e", "tru", "true", "null ", " null", '""', '"a', '"\\"', '"\\\\"', '"\\x"', '"\\u12G4"', '"\\u00e5"', '"\\u00e', '"\n"', "[1,]", "[,1]", "[1 2]", "[1,2]", '{"a":1,}', '{"a"}', '{"a":}', "{1:2}", '{"a":1 "b":2}', '{"a":1,"b":[]}', "{,}", "[:1]", "1 2", "{}{}", "[}", "{]", "[[]", "]", "[", "", " ", ":", ",", '"a":1', "[1]]", '{"a":[1,{"b":null}]}', "nulll", "NaN", "[Infinity]", "\\", '[\\"a"]', "{\"a\" : \"b\"\t}", '["a""b"]', '[1"a"]', '["a"1]', "[true false]", "5\u00a0", "\u00e5", '{"a":{"a":1}']
    rng = random.Random(12)

    def value(depth: int):
        kind = rng.randrange(8 if depth < 4 else 5)
        if kind < 5:
            return rng.choice([None, True, -1.5e3, 12, "a\"{", "å\\", "", "\n"])
        return [value(depth + 1) for _ in range(rng.randrange(4))] if kind < 7 else {rng.choice(["a", "b{", ""]): value(depth + 1) for _ in range(rng.randrange(3))}

    for _ in range(4000):
        text = json.dumps(value(0), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text = rng.choice([text[:at] + rng.choice(list('{}[]:,"\\ 1ea.-')) + text[at:], text[:at] + text[at + 1 :], text[:at]])
        cases.append(text)
    got = accepted(cases)
    assert [c for c, g in zip(cases, got, strict=True) if g != is_json(c)] == [] and 1000 < sum(got) < 3500
    rng.shuffle(cases)
    assert accepted(cases) == [is_json(c) for c in cases]


def test_strings_are_unescaped() -> None:
    texts = ["", "a", "\\", '"', "å\n\t\b\f\r/", "€", "😀x", "\\u0041", "\ufffd", "a\\\\n"]
    raw = [json.dumps(t, ensure_ascii=e)[1:-1] for t in texts for e in (True, False)] + ["\\/", "\\ud83dx", "\\ude00", "\\ud83d\\ud83d\\ude00"]
    want = [t for t in texts for _ in (0, 1)] + ["/", "\ufffdx", "\ufffd", "\ufffd😀"]
    assert nested._unescaped(pa.array(raw).cast(pa.binary())).to_pylist() == want


def test_any_depth_escaped_and_repeated_keys() -> None:
    def found(text: str) -> list[tuple]:
        return sorted(tuple(r.values())[1:5] for b in nested.flatten(pa.array([text], pa.large_string()), pa.array([1]), True) for r in b.to_pylist())

    depth = 5_000
    deep = '{"Page":' + '{"regions":[' * depth + '{"lines":{}}' + "]}" * depth + "}"
    assert len(found(deep)) == depth + 1
    assert accepted(["[" * 200_000 + "]" * 200_000, "[" * 200_000 + "]" * 199_999]) == [True, False]
    assert found(r'{"\u0050age":{"r\u0065gions":{"region\u005fid":"a\u00e5"}}}') == [("0", -1, -1, "aå")]
    assert found('{"Page":{"regions":[{},{}]},"Page":{"regions":[{"region_id":"x"},{"region_id":"y","region_id":"z"}]}}') == [("0", -1, -1, "x"), ("1", -1, -1, "z")]
    assert found('{"w":{"Page":{"regions":[{},{}]}},"w":{"Page":{"regions":{}}}}') == [("0", -1, -1, None)]


def test_tables(spark) -> None:
    page = {"Page": {"regions": [None, {"region_id": "r1", "transcription": "hej\nå", "polygon": "1,2 3,4", "regions": {"region_id": "r2", "lines": {"line_id": "l", "transcription": None, "polygon": [["5", "6"], {"y": 8, "x": 7}]}}}]}}
    rows = [(1, json.dumps(page), "2020", "a"), (1, json.dumps(page), "2021", "a"), (2, None, "2020", "a"), (3, "{", "2020", "a"), (None, json.dumps(page), "2020", None), (4, json.dumps({"Page": {"regions": [{"transcription": "x" * 1_000_000}]}}), None, None)]
    source = spark.createDataFrame([(i, p, t, n, n) for i, p, t, n in rows], "page_id long, payload string, loaded_at string, region_path string, line_no string")
    flat = nested.nodes(source).cache()
    assert sorted((tuple(r) for r in nested.regions(flat.where("page_id = 1")).collect()), key=str) == [(1, "1", None, "r1", "hej\nå"), (1, "1.0", "1", "r2", None)]
    assert [tuple(r) for r in nested.lines(flat.where("page_id = 1")).collect()] == [(1, "1.0", 0, "l", None)]
    assert sorted(tuple(r) for r in nested.points(flat.where("page_id = 1")).collect()) == [(1, "1", -1, 0, 1.0, 2.0), (1, "1", -1, 1, 3.0, 4.0), (1, "1.0", 0, 0, 5.0, 6.0), (1, "1.0", 0, 1, 7.0, 8.0)]
    assert nested.regions(flat.where("page_id = 4")).first()["transcription"] == "x" * 1_000_000
    assert nested.nodes(source.where("false")).count() == 0
    assert nested.nodes(source, values=False).count() == flat.count()


def test_queries(spark, sf_dir) -> None:
    assert all(q(spark, sf_dir).count() > 0 for q in corpus.QUERIES.values())


def test_found_copies_come_from_a_written_container(spark, sf_dir) -> None:
    from docflow.session import shared_dir

    folder = Path(re.sub("^file:/*", "/", shared_dir(spark))) / "docflow"
    before = set(folder.glob("archive-*"))
    found = sorted(r["file_id"] for r in corpus.p4_found(spark, sf_dir).collect())
    new = set(folder.glob("archive-*")) - before
    assert len(new) == 1
    container = archive.read(spark, str(new.pop()))
    stored = {r["file_id"]: bytes(r["bytes"]).decode() for r in archive.restore(container.blocks).where("intact").collect()}
    bodies = {r["file_id"]: r["body"] for r in corpus.table(spark, sf_dir, "label_files").where("body is not null").collect()}
    assert found and found == sorted(set(bodies) - set(stored)) and all(bodies[i] == body for i, body in stored.items())
