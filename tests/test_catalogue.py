from __future__ import annotations

import collections
import glob
import math
import os

import duckdb
import pytest

from docflow.plans import registry


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, sf_dir, duck, name) -> None:
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = collections.Counter(tuple(plain(dict(zip(names, row, strict=True))[c]) for c in columns) for row in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, sf_dir, name) -> None:
    assert registry.QUERIES[name](spark, sf_dir).count() >= 0


@pytest.mark.parametrize("name", ["cer_by_volume", "band_order", "mixed_split", "p4_found", "merged_boxes"])
def test_same_under_any_partitioning(spark, sf_dir, name) -> None:
    results = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(collections.Counter(map(str, registry.QUERIES[name](spark, sf_dir).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
