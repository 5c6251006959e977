from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docflow import session


def test_pick(spark) -> None:
    rows = spark.createDataFrame([(1, 2, 3)], "a int, A int, b int")
    assert session.pick(rows, "b", "A").collect() == [(3, 2)]
    assert session.pick(rows.toDF("a", "a", "b"), "a").first()[0] == 1
    with pytest.raises(ValueError, match="c"):
        session.pick(rows, "c")


def test_spread(spark) -> None:
    few = spark.range(100, numPartitions=1)
    assert session.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100, numPartitions=50)
    assert session.spread(many) is many
    grouped = few.groupBy((F.col("id") % 3).alias("k")).count()
    assert session.spread(grouped) is grouped


def test_materialise_and_bounds(spark) -> None:
    kept = session.materialise(spark.range(10), "x")
    assert kept.count() == 10 and kept.inputFiles()[0].count(session.shared_dir(spark).removeprefix("file://")) == 1
    assert len(session.small_rows(kept, 10, "rows")) == 10
    with pytest.raises(ValueError, match="rows"):
        session.small_rows(kept, 9, "rows")


def test_entry(spark) -> None:
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
